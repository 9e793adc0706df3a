"""Match rows from text lines."""

from endsight.sources.tables import tmap_items


def test_filters_do_not_split_lines_again(spark):
    lines = spark.createDataFrame(
        [(1, "g\tr\t=\tq\tq\tx\t1\t2\t3\t4"), (2, " g r j q q x 1 2 3 4.7 "), (3, "g\tr\t=\tq\tq\tx\t1\tbad\t3\t4"), (4, "# g"), (5, "a b")],
        "row_no long, value string",
    )
    items = tmap_items(lines)
    assert sorted((r.row_no, r.class_code, r.tpm, r.length) for r in items.collect()) == [(1, "=", 2.0, 4), (2, "j", 2.0, 4)]
    assert items._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 6
