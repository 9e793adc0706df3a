"""The distributed helpers against brute force, skewed and salted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from endsight.operators import annotation as N
from endsight.operators import scale
from endsight.operators.ranking import quantiles
from endsight.operators.sites import nearest_reference

random.seed(7)


@pytest.mark.parametrize("skew", ["true", "false"])
def test_overlap_join(spark, skew):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", skew)
    points = sorted({random.randrange(0, 60_000) for _ in range(300)} | {5})
    spans = [(a, a + random.choice([1, 50, 900, 5_000, 40_000])) for a in (random.randrange(-100, 60_000) for _ in range(400))]
    spans += [(100, 200)] * 50
    p = spark.createDataFrame([("c", x) for x in points], "chrom string, position bigint")
    s = spark.createDataFrame([("c", i, *ab) for i, ab in enumerate(spans)], "chrom string, i int, a bigint, b bigint")
    try:
        got = scale.overlap_join(p, s, on=["chrom"], point="position", low="a", high="b").select("position", "i").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    want = sorted((x, i) for x in points for i, (a, b) in enumerate(spans) if a <= x <= b)
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("skew", ["true", "false"])
def test_crowded_join(spark, skew):
    """F16: narrow spans meet lists of points, wide ones single points; each pair appears once."""
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", skew)
    points = [(x, t) for x in sorted({random.randrange(0, 60_000) for _ in range(200)} | {5, 255, 256}) for t in "+-"]
    widths = [0, 1, 50, 255, 256, 900, scale.WIDE - 1, scale.WIDE, 40_000]
    spans = [(a, a + random.choice(widths)) for a in (random.randrange(-300, 60_000) for _ in range(400))] + [(100, 260)] * 50
    p = spark.createDataFrame([("c", *x) for x in points] + [(None, 5, "+")], "chrom string, position bigint, strand string")
    s = spark.createDataFrame([("c", i, *ab) for i, ab in enumerate(spans)] + [("c", -1, None, 9)], "chrom string, i int, a bigint, b bigint")
    try:
        joined = scale.crowded_join(p, s, on=["chrom"], point="position", low="a", high="b")
        got = joined.select("position", "strand", "i").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    want = sorted((x, t, i) for x, t in points for i, (a, b) in enumerate(spans) if a <= x <= b)
    assert sorted(map(tuple, got)) == want


def test_salted_join(spark):
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k int, v int")
    small = spark.createDataFrame([(i, -i) for i in range(0, 900, 2)], "k int, w int")
    salted, repeated = scale.salt_hot_keys(big, small, ["k"], rows_per_slice=50)
    assert salted.where("k = 0").select("_slice").distinct().count() > 5
    got = salted.join(repeated, ["k", "_slice"], "left").select("k", "v", "w").collect()
    assert sorted((r.k, r.v, r.w) for r in got if r.w is not None) == sorted((k, v, -k) for k, v in ((0 if i % 3 else i, i) for i in range(900)) if k % 2 == 0)
    assert len(got) == 900


def test_ordered_scan(spark):
    rows = [(g, i, random.randrange(10)) for g in "ab" for i in range(500)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, x int")
    out = scale.ordered_scan(df, group=["g"], order=[F.col("i").desc()], sums={"x": F.col("x")}, previous={"x": F.col("x")})
    for g in "ab":
        got = sorted((r for r in out.where(F.col("g") == g).collect()), key=lambda r: -r.i)
        xs = [r.x for r in got]
        assert [r.run_x for r in got] == list(np.cumsum(xs))
        assert [r.prev_x for r in got] == [None, *xs[:-1]] and {r.all_x for r in got} == {sum(xs)}


def test_quantiles(spark):
    values = [random.choice([1.5, 2.0, random.random() * 9]) for _ in range(301)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = quantiles(df, by=["g"], value="v", names={"q25": 0.25, "m": 0.5}).first()
    assert row.q25 == pytest.approx(np.quantile(values, 0.25)) and row.m == pytest.approx(np.quantile(values, 0.5))


def test_nearest_reference(spark):
    sites = [("TSS", "chr1", random.randrange(1, 90_000), "+") for _ in range(200)]
    refs = [("TSS", "1", random.randrange(20_000, 60_000), "+", i) for i in range(40)]
    s = spark.createDataFrame(sites, "site_type string, chrom string, position bigint, strand string")
    r = spark.createDataFrame(refs, "site_type string, chrom string, position bigint, strand string, ord int")
    for row in nearest_reference(s, r, order="ord").collect():
        best = min(refs, key=lambda x: (abs(x[2] - row.position), x[4]))
        assert row.closest_ref_position == best[2] and row.label == int(abs(best[2] - row.position) <= 50)


def cell_groups(rows, tol):
    """Groups of the cell rule, cell by cell."""
    cells = {}
    for t in rows:
        cells.setdefault((t[4], t[5], t[6] // (tol + 1), t[7] // (tol + 1)), []).append(t)
    mean = {c: (sum(t[6] for t in ts) / len(ts), sum(t[7] for t in ts) / len(ts)) for c, ts in cells.items()}
    best = {}
    for c in cells:
        near = [
            d
            for d in cells
            if d[:2] == c[:2]
            and d != c
            and abs(d[2] - c[2]) <= 1
            and abs(d[3] - c[3]) <= 1
            and all(abs(x - y) <= tol for x, y in zip(mean[c], mean[d]))
            and (len(cells[d]), -d[2], -d[3]) > (len(cells[c]), -c[2], -c[3])
        ]
        if near:
            best[c] = max(near, key=lambda d: (len(cells[d]), -d[2], -d[3]))
    groups = {}
    for c, ts in cells.items():
        target = best[c] if c in best and best[c] not in best else c
        groups.setdefault(target, []).extend(t[3] for t in ts)
    return sorted(sorted(g) for g in groups.values())


def test_consensus_follows_the_cell_rule(spark):
    rows = []
    for a, asm in enumerate(["x", "y", "z"]):
        for i in range(150):
            base = random.randrange(0, 40) * 90
            rows.append((asm, a, i, f"{asm}{i}", "chr1", random.choice("+-"), base + random.randrange(60), base + 3000 + random.randrange(90)))
    df = spark.createDataFrame(
        rows, "assembler_id string, assembly_ord int, file_ord int, transcript_id string, chrom string, strand string, tss bigint, tes bigint"
    )
    grouped = N.consensus_groups(df, tolerance=50).groupBy("chrom", "strand", "component").agg(
        F.sort_array(F.collect_list("transcript_id")).alias("ids")
    )
    assert sorted(list(r.ids) for r in grouped.collect()) == cell_groups(rows, 50)


def test_nearest_reference_over_blocks(spark, monkeypatch):
    from endsight.operators import sites

    monkeypatch.setattr(sites, "BLOCK", 3)
    reference = [("TSS", "chr1", "+", p) for p in (5, 1_000, 40_000, 41_000, 90_000_000)] + [("TES", "chr1", "+", 7)]
    places = [0, 500, 600, 20_000, 20_501, 40_500, 3_000_000, 60_000_000, 99_000_000]
    rows = [(f"t{p}", "TSS", "chr1", p, "+") for p in places] + [("u", "TSS", "chr2", 5, "+")]
    ref = spark.createDataFrame(reference, "site_type string, chrom string, strand string, position long")
    found = sites.nearest_reference(spark.createDataFrame(rows, "transcript_id string, site_type string, chrom string, position long, strand string"), ref)
    tss = [r[3] for r in reference if r[0] == "TSS"]
    for r in found.collect():
        want = min(tss, key=lambda p: (abs(p - r.position), p)) if r.chrom == "chr1" else 0
        assert r.closest_ref_position == want and r.label == int(r.chrom == "chr1" and abs(want - r.position) <= 50)
