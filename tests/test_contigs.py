"""Contig numbers and the train split."""

from pyspark.sql import functions as F

from endsight.functions.contigs import autosome_number, in_train_split

NAMES = {
    "chr1": 1, "CHR22": 22, "7": 7, "chr23": None, "chr0": None, "chr007": 7, "NC_000005.10": 5, "nc_12": 12, "chrNC_000001.1": 1,
    "chrNC_000.1": None, "NC_5.x": None, "NW_1.1": None, "GL000191": None, "chrchr5": None, "+5": None, "5.7": None, "chrX": None,
    "": None, " chr9 ": 9, "99999999999": None, "chr": None, "NC_1.": None,
}


def test_contig_numbers(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, None]], "c string")
    rows = df.select("c", autosome_number(F.col("c")).alias("n"), in_train_split(F.col("c"), (10, -3)).alias("t")).collect()
    assert {r.c: r.n for r in rows} == {**NAMES, None: None}
    assert all(r.t is (r.n is not None and r.n <= 10) for r in rows)


def test_split_searches_a_name_once(spark):
    df = spark.createDataFrame([("chr1",)], "c string").where(in_train_split(F.col("c"), (1, 10)))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp") == 1
