"""Running sums over blocks against pairs of site and read."""

import numpy as np
import pytest

import __spark_entry__ as entry
from endsight.operators import features as X
from endsight.operators import profile

READ = "chrom string, ref_start long, ref_end long, mapq int, is_reverse boolean, ts string, cigar string, seq string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        gap = [0, 0, 60, 9000][i % 4]
        start = int(rng.integers(3500, 9500))
        left, right = int(rng.integers(0, 6)), int(rng.integers(0, 40))
        parts = [f"{left}S" * bool(left), "15M", f"{gap}N" * bool(gap), f"{1 + i % 200}M", f"{right}S" * bool(right)]
        seq = "ACGTT" * ((left + right + 16 + i % 200) // 5 + 1)
        rows.append(("chr1", start, start + 16 + i % 200 + gap, i % 60, i % 3 == 0, [None, "+", "-", "?"][i % 4 if i % 5 else 0], "".join(parts), seq))
    rows += [("chr1", p, p, 60, False, None, "5S", "AAAAA") for p in (4000, 4095, 4096, 4196)]
    # a boundary far behind its own read, after a long clip
    rows.append(("chr1", 5000, 5030, 60, False, None, "400S10M10N10M", "A" * 420))
    return spark.createDataFrame(rows, READ)


def test_blocks_agree_with_pairs(spark, crowd):
    places = [1, 3399, 3995, 4090, 4095, 4096, 4097, 4196, 4295, 5415, 8191, 8192, 8300, 12000, 18400, 30000]
    sites = spark.createDataFrame([("chr1", p, s) for p in places for s in "+-."], "chrom string, position long, strand string")
    cfg = X.FeatureConfig()
    parsed = X.usable_reads(crowd, cfg)
    old = X.histogram_sums(X.site_histograms(sites, X.read_shapes(parsed), cfg), cfg)
    want = {tuple(r[:3]): r.asDict() for r in X.read_features(old, cfg).collect()}
    got = {tuple(r[:3]): r.asDict() for r in X.read_features(X.site_sums(sites, parsed, cfg), cfg).collect()}
    assert len(got) == 48 and len(want) > 30
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value or 0, abs=1e-9) if name not in X.SITE else value), (key, name)


def test_crossing_reads_in_small_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    near = np.sort(rng.integers(-300, 4200, 500))
    counter = profile.Counter()
    counter.add(near, near + rng.integers(1, 90, 500), rng.integers(1, 5, 500))
    a, b, n = counter.merged()
    whole = profile._crossing(a, b, n, 100)
    monkeypatch.setattr(profile, "CELLS", 64)
    for one, other in zip(whole, profile._crossing(a, b, n, 100)):
        assert np.allclose(one, other)
    for p in (0, 777, 4095):
        at = {x: n[(a == x) & (b > p - 100)].sum() for x in set(a[a <= p - 100].tolist())}
        assert whole[0][p] == pytest.approx(sum(c * np.log2(c) for c in at.values() if c))
        assert whole[1][p] == pytest.approx(sum(c / (p - x) for x, c in at.items()))


@pytest.mark.parametrize(
    "name",
    ["agg_04_site_counts", "agg_05_clip_length_stats", "agg_06_mapq_stats", "agg_07_coverage_before_after",
     "agg_08_nearest_splice", "agg_09_softclip_bias", "agg_10_position_entropy", "agg_11_coverage_gradient",
     "agg_12_start_moments", "agg_13_degradation_slope", "agg_14_skewness", "agg_15_ratio_features"],
)
def test_sites_are_not_paired_with_reads(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "_level" not in plan and "FlatMapGroupsInArrow" in plan


def test_rows_grow_with_reads_and_sites(spark, crowd):
    cfg = X.FeatureConfig()
    sites = spark.range(3500, 9500).selectExpr("'chr1' as chrom", "id as position", "'+' as strand")
    rows = profile.block_rows(sites, X.usable_reads(crowd, cfg), cfg, ())
    assert rows.where(f"kind = {profile.PLACE}").count() == 6000
    assert rows.where(f"kind = {profile.READ}").count() < 3 * crowd.count() < X.site_read_overlap(sites, X.read_spans(crowd, cfg), cfg).count() / 5


def test_rows_carry_only_what_the_parts_need(spark, crowd):
    cfg = X.FeatureConfig()
    sites = spark.createDataFrame([("chr1", 4090, "+")], "chrom string, position long, strand string")
    parsed = X.usable_reads(crowd, cfg)
    own = {"clips": {"cs", "ce"}, "bias": {"flags"}, "mapq": {"q1", "q2"}, "splice": {"x"}, "flanks": set(), "starts": set()}
    for part, columns in own.items():
        given = set(profile.block_rows(sites, parsed, cfg, (part,)).columns)
        assert given == {"chrom", "block", "kind", "a", "b", "st", "n", "strand"} | columns
