"""Clipped ends summed over blocks against rows of site and end."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from endsight.operators import features as X
from endsight.operators import softclips as P
from endsight.plans import catalog_more as more

READ = "chrom string, ref_start long, ref_end long, mapq int, is_reverse boolean, ts string, cigar string, seq string"


@pytest.mark.parametrize("shortest", [2, 5])
def test_sums_equal_those_of_the_rows(spark, shortest):
    rows = []
    for i in range(500):
        start, left, right, gap = 3900 + (i * 53) % 500, i % 9, i % 7, 9000 if i % 50 == 0 else 0
        parts = [f"{left}S" * bool(left), "20M", f"{gap}N" * bool(gap), "9M", f"{right}S" * bool(right)]
        seq = ("ACGT TGCÄAGGA"[i % 11 :] + "CCGATTAC" * 5)[: left + 29 + right]
        rows.append(("chr1", start, start + 29 + gap, i % 60, i % 2 == 0, "+" if i % 5 else None, "".join(parts), seq))
    reads = spark.createDataFrame(rows + rows[:90], READ)
    places = [0, 3700, 3950, 4095, 4096, 4100, 4290, 4500, 8192, 13100, 20000]
    sites = spark.createDataFrame([("chr1", p, s) for p in places for s in "+-"], "chrom string, position long, strand string")
    cfg = X.FeatureConfig()
    want = P.softclip_rows(sites, reads, cfg).where(f"length(trim(sequence)) >= {shortest} or {shortest} = 2").groupBy(*X.SITE, "clip_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance_to_site").alias("distance"),
        F.expr("sum(bigint(sequence_length)) as bases"), F.max("sequence").alias("last_sequence"),
    )
    got = P.softclip_sums(sites, reads, cfg, min_length=shortest).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("name", ["prj_10_softclip_rows", "jon_22_softclip_label", "jon_23_clip_count_reconcile", "agg_40_site_clip_dataset"])
def test_sites_are_not_paired_with_ends(spark, name, monkeypatch):
    def paired(*_, **__):
        raise AssertionError("pairs of site and clipped end")

    monkeypatch.setattr(P, "_around", paired)
    entry.queries()[name](spark, "/root/testdata/sf0.001")


def test_clip_model_reads_the_rows_of_sampled_sites_only(spark, monkeypatch):
    """the model's rows equal those from a row per site and clipped end, without building these."""
    sf = "/root/testdata/sf0.001"
    labeled = P.label_softclips(more.clip_rows(spark, sf), more.view(spark, sf, "v_ref_site"), "TSS").where("clip_type = 'start'")
    want = P.site_clip_dataset(labeled, "start").join(P.sequence_statistics(labeled, X.SITE), list(X.SITE))
    doubles = {c for c, t in want.dtypes if t == "double"}
    columns = [F.round(c, 9).alias(c) if c in doubles else F.col(c) for c in want.columns]
    expected = sorted(map(tuple, want.select(*columns).collect()))

    def paired(*_, **__):
        raise AssertionError("a row per site and clipped end")

    monkeypatch.setattr(P, "_around", paired)
    _, got = more.clip_model_rows(spark, sf)
    assert sorted(map(tuple, got.select(*columns).collect())) == expected != []
    assert entry.queries()["mlo_10_clip_model"](spark, sf).count() == 2
