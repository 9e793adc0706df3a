import pytest
from pyspark.sql import functions as F

from endsight.functions.attributes import score_text, set_coverage

NUMBERS = [0.0001, 0.000125, -0.0001, 0.00001, 1.25e-10, 0.0, 0.5, 0.001, 1.0, 123456.75, 1e7, 12345678.9, -2.5e9, 1e15, 1e16, 1.5e300]


def test_numbers_as_short_text(spark):
    rows = spark.createDataFrame([(x, repr(x)) for x in NUMBERS], "x double, want string")
    assert [(r.got, r.want) for r in rows.select(score_text(F.col("x")).alias("got"), "want").collect() if r.got != r.want] == []


@pytest.mark.parametrize("text", ["GENE1", "1E5x", "", None])
def test_other_text_stays(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(score_text(F.col("x")).alias("x")).first().x == text


def test_small_coverage_is_written_plainly(spark):
    rows = spark.createDataFrame([('gene_id "a"; cov "3";', 0.0001), ('gene_id "a"', 1e-5)], "a string, v double")
    got = [r.a for r in rows.select(set_coverage(F.col("a"), F.col("v")).alias("a")).collect()]
    assert got == ['gene_id "a"; cov "0.0001";', 'gene_id "a"; cov "1e-05";']
