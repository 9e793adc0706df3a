"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) is the data, ``BENCH_CPUS`` the number
of local cores.  Every query is run once on the smallest data set to warm the JVM,
then timed over its complete result, which is produced and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from endsight.plans import catalog
from endsight.session import local_session

HEADLINE = (
    "prj_01_candidate_sites",
    "jon_02_proximity_label",
    "jon_03_nearest_reference",
    "agg_25_label_stats",
    "agg_01_exon_stats",
    "agg_04_site_counts",
    "agg_10_position_entropy",
    "agg_17_kmer_stats",
    "prj_23_stage2_derived",
    "jon_12_gtf_filter_by_score",
    "jon_16_site_set_overlap",
    "jon_26_exact_structure_match",
    "agg_23_average_precision",
    "agg_33_ks_two_sample",
    "win_05_roc_sweep",
    "win_06_sweep_auc",
    "snk_08_pr_summary",
    "agg_44_novel_select",
)


def run(query, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS") or os.cpu_count())
    catalog.load()
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    times = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        if os.path.isdir(warm):
            run(query, spark, warm)
        times[name] = round(run(query, spark, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
