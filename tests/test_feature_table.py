"""The one-pass feature table against the operators that compute one feature each."""

import pytest

from endsight.operators import features as X
from endsight.operators import softclips as P

READ = (
    "chrom string, ref_start long, ref_end long, mapq int, is_reverse boolean, ts string, cigar string, seq string"
)


@pytest.fixture
def reads(spark):
    rows = []
    for i in range(400):
        start = 900 + (i * 37) % 700
        left, right, gap = i % 4, i % 26, 60 if i % 3 == 0 else 0
        end = start + 40 + gap
        parts = [f"{left}S" * bool(left), "20M", f"{gap}N" * bool(gap), "20M", f"{right}S" * bool(right)]
        seq = ("ACGTTGCAAGGATTTCCCAGGTGAGC" * 4)[: left + 40 + right]
        rows.append(("chr1", start, end, i % 60, i % 2 == 0, "+" if i % 5 else None, "".join(parts), seq))
    rows += rows[:50]
    rows.append(("chr1", 100, 9000, 60, False, None, "20M8860N20M", "A" * 40))
    rows.append((None, None, None, None, None, None, None, None))
    rows.append(("chr1", 1000, 1040, 60, False, None, None, None))
    return spark.createDataFrame(rows, READ)


@pytest.fixture
def sites(spark):
    rows = [("chr1", p, s) for p in (5, 950, 1000, 1003, 1250, 1800) for s in "+-"] + [("chr2", 1000, "+")]
    return spark.createDataFrame(rows, "chrom string, position long, strand string")


@pytest.mark.parametrize("coverage_window", [50, 100, 600])
def test_histograms_give_the_features_of_single_operators(reads, sites, coverage_window):
    cfg = X.FeatureConfig(coverage_window=coverage_window, legacy_columns=True)
    pairs = X.site_read_overlap(sites, X.read_spans(reads, cfg), cfg)
    single = (
        sites.join(X.read_features(X.read_sums(pairs, cfg), cfg), list(X.SITE), "left")
        .join(X.position_entropy(pairs), list(X.SITE), "left")
        .join(X.clip_length_medians(sites, reads, cfg), list(X.SITE), "left")
        .join(X.nearest_splice(sites, reads, cfg), ["chrom", "position"], "left")
    )
    single = single.fillna(cfg.splice_site_window, ["nearest_splice_dist"]).fillna(0)
    names = [c for c in single.columns if c not in X.SITE]
    got = {tuple(r[:3]): r for r in X.coordinate_features(sites, reads, cfg).select(*X.SITE, *names).collect()}
    want = {tuple(r[:3]): r for r in single.select(*X.SITE, *names).collect()}
    assert got.keys() == want.keys() and len(got) == 13
    for key, row in want.items():
        for name in names:
            assert got[key][name] == pytest.approx(row[name], abs=1e-9), (key, name)


def test_reads_are_scanned_once(reads, sites, tmp_path):
    path = str(tmp_path / "reads")
    reads.write.parquet(path)
    table = X.coordinate_features(sites, sites.sparkSession.read.parquet(path), X.FeatureConfig())
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert path not in plan


def test_no_reads(reads, sites):
    table = X.site_features(sites, reads.where("false"))
    assert table.count() == 13
    assert table.where("total_reads = 0 and nearest_splice_dist = 300").count() == 13


def test_equal_clips_collapse_before_the_join(reads, sites):
    cfg = X.FeatureConfig()
    names = [*X.SITE, "clip_type", "sequence", "read_position", "mapping_quality"]
    rows = P.softclip_rows(sites, reads, cfg).groupBy(*names).count()
    sums = P.softclip_counts(sites, reads, cfg).groupBy(*names).agg({"n": "sum"})
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, sums.collect()))
    assert rows.where("count > 1").count() > 0


def test_site_labels_reach_every_clip(reads, sites):
    reference = sites.where("position = 1000").selectExpr("*", "'TSS' as site_type")
    clips = P.softclip_rows(sites, reads, X.FeatureConfig())
    by_site = P.label_clips_by_site(clips, sites, reference)
    one = P.label_softclips(clips, reference, "TSS")
    assert sorted(map(str, by_site.where("site_type = 'TSS'").select(*one.columns).collect())) == sorted(map(str, one.collect()))
    assert by_site.where("site_type = 'TES' and label = 1").count() == 0
