"""Clip columns from running sums over blocks against joins of site and clip."""

import numpy as np
import pytest

import __spark_entry__ as entry
from endsight.operators import features as X


def test_blocks_agree_with_joins(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("AACGTTN") + ["Ä"])
    rows = [
        ("chr1", int(rng.integers(4050, 4150)), "".join(rng.choice(letters, rng.integers(1, 12))), int(rng.integers(1, 4)))
        for _ in range(400)
    ]
    rows += [("chr1", 8192, "GG", 2), ("chr2", 4100, "ACGT", 1)]
    clips = spark.createDataFrame(rows, "chrom string, clip_pos long, seq string, n long")
    places = [*range(4030, 4170, 7), 4095, 4096, 8182, 8202, 8203, 20000]
    sites = spark.createDataFrame([("chr1", p, "+") for p in places], "chrom string, position long, strand string")
    cfg = X.FeatureConfig(k_values=(2, 3, 5), legacy_columns=True)
    keys = ["chrom", "position"]
    want = X.clip_composition(sites, clips, cfg).join(X.kmer_statistics(sites, clips, cfg), keys, "left").fillna(0)
    got = {tuple(r[:2]): r.asDict() for r in X.clip_profile(sites, clips, cfg).collect()}
    rows = [r.asDict() for r in want.collect()]
    assert len(rows) == len(got) > 15
    for row in rows:
        mine = got[(row["chrom"], row["position"])]
        assert mine.keys() == row.keys()
        for name, value in row.items():
            assert mine[name] == (value if name in keys else pytest.approx(value, abs=1e-9)), (row["position"], name)


@pytest.mark.parametrize("name", ["agg_16_clip_seq_summary", "agg_17_kmer_stats"])
def test_clips_are_not_joined_with_sites(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "clip_pos#" not in plan.split("FlatMapGroupsInArrow")[0]
