"""Evaluation of scored sites."""

from endsight.operators import ranking as K
from endsight.operators import sites as S
from endsight.operators import transcripts as T
from endsight.plans import jobs


def test_places_are_labelled_once(spark, monkeypatch):
    """several scored rows of one place, same measures as with a label per scored row."""
    places = [("TSS" if i % 2 else "tes", "chr1" if i % 3 else "2", 100 * (i // 2), "+-"[i % 2]) for i in range(40)]
    scored = spark.createDataFrame(
        [(f"T{i}.{j}", *p, (i * 7 + j) % 10 / 10.0, (i * 3 + j) % 10 / 10.0) for i, p in enumerate(places) for j in range(1 + i % 4)],
        "transcript_id string, site_type string, chrom string, position long, strand string, p_site_rf double, p_site_xgb double",
    )
    cov = spark.createDataFrame(
        [(s, c, c, p, p, float(i)) for i, (_, c, p, s) in enumerate(places)],
        "strand string, tss_chrom string, tes_chrom string, tss_pos long, tes_pos long, coverage double",
    )
    reference = spark.createDataFrame(
        [(t.upper(), c, p + 30, s, "NOVEL_TX_1" if i % 2 else "R") for i, (t, c, p, s) in enumerate(places[::3])],
        "site_type string, chrom string, position long, strand string, transcript_id string",
    )
    rows = S.novel_label(S.proximity_label(T.site_mean_coverage(scored, cov), reference), reference)
    long = rows.selectExpr(
        "site_type", "label", "novel_label", "stack(3, 'rf', p_site_rf, 'xgb', p_site_xgb, 'baseline', coverage) as (score_name, score)"
    ).selectExpr("site_type", "score_name", "score", "stack(2, 'all', label, 'novel', novel_label) as (truth, y)")
    by = ["site_type", "score_name", "truth"]
    want = sorted(map(str, K.average_precision(long, by=by, label="y", score="score").collect()))
    seen, label = [], S.proximity_label

    def watched(sites, *args, **named):
        seen.append(sites)
        return label(sites, *args, **named)

    monkeypatch.setattr(S, "proximity_label", watched)
    got = sorted(map(str, jobs.evaluate_sites(scored, cov, reference).collect()))
    assert got == want and len(got) == 12
    for sites in seen:
        assert sites.count() == sites.select("site_type", "chrom", "position", "strand").distinct().count()
