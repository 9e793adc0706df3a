"""Cases in which rows, columns or answers could be lost."""

from pyspark.sql import functions as F

from endsight.operators import annotation, softclips, transcripts
from endsight.operators.scale import ordered_scan
from endsight.sources.reads import parse_sam

LINE = "line_no long, value string, n_columns int, chrom string, feature string, strand string, attrs string, transcript_id string, gene_id string"


def line(spark, columns):
    attrs = 'transcript_id "t"; cov "1.0";'
    cells = ["chr1", "x", "transcript", "1", "9", ".", "+", ".", attrs, *[f"c{i}" for i in range(columns - 9)]]
    return spark.createDataFrame([(1, "\t".join(cells), columns, "chr1", "transcript", "+", attrs, "t", "g")], LINE)


def test_rewritten_lines_keep_all_columns(spark):
    scores = spark.createDataFrame([("t", 0.5)], "transcript_id string, score double")
    for columns in (9, 10, 1209):
        value = annotation.inject_score(line(spark, columns), scores).first()["value"].split("\t")
        assert len(value) == columns and value[0] == "chr1" and "0.5" in value[8]
        chosen = spark.createDataFrame([("a", "t", "G", "T")], "assembler_id string, transcript_id string, new_gene_id string, new_transcript_id string")
        renamed = annotation.rename_lines(line(spark, columns).withColumn("assembler_id", F.lit("a")), chosen)
        cells = renamed.first()["value"].split("\t")
        assert len(cells) == columns and 'gene_id "G"' in cells[8] and cells[9:] == [f"c{i}" for i in range(columns - 9)]


def test_deep_sites_are_compared(spark):
    clips = spark.range(201).selectExpr("'chr1' as chrom", "5L as position", "'+' as strand", "'start' as clip_type")
    counts = spark.createDataFrame([("chr1", 5, "+", 201)], "chrom string, position long, strand string, start_soft_clip_count long")
    assert tuple(softclips.reconcile_counts(counts, clips).first()) == (1, 0)


def test_sample_takes_every_contig(spark):
    rows = [(f"chr{i}", 10 * i, "+", i % 2, "start", "ACGTAC") for i in range(1, 13)] + [("chrX", 1, "+", None, "start", "ACGTAC")]
    labeled = spark.createDataFrame(rows, "chrom string, position long, strand string, label int, clip_type string, sequence string")
    got = softclips.site_clip_dataset(labeled, "start").collect()
    assert {r.chrom for r in got} == {f"chr{i}" for i in range(1, 13)}
    assert softclips.site_clip_dataset(labeled.where("label = 1"), "start").count() == 6


def test_null_groups_are_groups(spark):
    rows = [(None, 1), (None, 2), ("a", 3)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = ordered_scan(df, group=["g"], order=[F.col("x")], sums={"s": F.col("x")}, previous={"x": F.col("x")})
    assert sorted((r.g or "", r.x, r.run_s, r.all_s, r.prev_x) for r in got.collect()) == [
        ("", 1, 1, 3, None),
        ("", 2, 3, 3, 1),
        ("a", 3, 3, 3, None),
    ]


def test_numbers_beat_nan(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("t", nan, 1), ("t", 0.9, 2), ("u", nan, 3)], "transcript_id string, p double, k int")
    best = {r.transcript_id: (r.p, r.k) for r in transcripts.best_row_per_transcript(rows, "p").collect()}
    assert best["t"] == (0.9, 2) and best["u"][1] == 3
    sites = spark.createDataFrame([("t",), ("u",), ("v",)], "transcript_id string")
    got = {r.transcript_id: r.p for r in transcripts.site_probabilities(sites, rows, ["transcript_id"], ["p"]).collect()}
    assert got == {"t": 0.9, "u": 0.5, "v": 0.5}
    placed = rows.selectExpr("*", "'c' as chrom", "1 as position", "'+' as strand", "'TSS' as site_type")
    assert transcripts.best_row_per_site(placed, "p").first()["p"] == 0.9


def test_bad_numbers_in_alignments_are_null(spark):
    text = "r\tx\tchr1\tfour\t60\t4M\t*\t0\t0\tACGT\tIIII"
    row = parse_sam(spark.createDataFrame([(text,)], "value string")).first()
    assert row["ref_start"] is None and row["is_unmapped"] is None and row["mapq"] == 60


def test_the_ranker_query_trains_the_whole_ranker(spark, monkeypatch):
    from endsight.operators import models
    from endsight.plans import catalog_more

    seen = []

    def fit(train, features, *, kind, params=None, **rest):
        seen.append((kind, models.RANKER | (params or {})))
        return models.Classifier(list(features), None, 0.0)

    monkeypatch.setattr(models, "fit", fit)
    catalog_more.mlo_03(spark, "/root/testdata/sf0.001")
    assert seen == [("ranker", models.RANKER)] and seen[0][1]["maxIter"] == 300
