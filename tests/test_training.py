"""Tables that training reads more than once."""

from pyspark.sql import functions as F

from endsight.operators import models as M
from endsight.operators import transcripts
from endsight.plans import jobs


def test_rows_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return i / 40

    df = spark.range(40).selectExpr("id", "int(id % 2) as label", "id % 3 as g").withColumn("p", score("id"))
    assert {r.n_items for r in M.validation_metrics(df, "p", ["g"]).collect()} == {13, 14}
    assert seen.value == 40


def test_ends_take_the_best_probabilities_of_a_coordinate(spark):
    features = spark.createDataFrame([("chr1", 5, "+", 3), ("chr1", 90, "+", 4)], "chrom string, position long, strand string, total_reads long")
    scored = spark.createDataFrame(
        [("a", "TSS", "chr1", 5, "+", 0.2, 0.9), ("b", "TSS", "chr1", 5, "+", 0.7, 0.1), ("a", "TES", "chr1", 90, "+", None, 0.3)],
        "transcript_id string, site_type string, chrom string, position long, strand string, p_site_rf double, p_site_xgb double",
    )
    cov = spark.createDataFrame(
        [("a", "+", "1", "1", 5, 90, 2.0, 4, 4, 4, 4, 4.0, 4, 1)],
        "transcript_id string, strand string, tss_chrom string, tes_chrom string, tss_pos long, tes_pos long, coverage double, first_exon_length long,"
        " last_exon_length long, max_exon_length long, min_exon_length long, mean_exon_length double, total_exon_length long, exon_count long",
    )
    ends = jobs.transcript_ends(cov, features, scored)
    got = {b: jobs.transcript_rows(ends, b).first() for b in jobs.BACKENDS}
    assert [(r.probability_tss, r.probability_tes) for r in got.values()] == [(0.7, 0.5), (0.9, 0.3)]
    assert {(r.total_reads_tss, r.total_reads_tes, r.transcript_length) for r in got.values()} == {(3, 4, 85)}
    assert not any(c.startswith("p_site") for c in M.feature_names(jobs.transcript_rows(ends, "rf")))


def test_places_weigh_as_much_as_their_copies(spark):
    """A packed row with a number of copies stands for as many equal rows, in models and in measures."""
    names = ["a", "b"]
    rows = spark.range(240).selectExpr("double(id % 7) as a", "double(id % 5) as b", "int(id % 7 > 3) as label", "id % 4 + 1 as n")
    repeated = rows.selectExpr("a", "b", "label", "explode(sequence(1L, n)) as i").drop("i")
    params = {"maxIter": 3, "maxDepth": 2, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    one = M.fit(M.packed(rows, names, ["label", "n"]), names, kind="xgb", params=params, copies="n")
    all_rows = M.fit(repeated, names, kind="xgb", params=params)
    once = one.score(M.packed(rows, names, ["label", "n"]), "p", ["label", "n"], names).selectExpr("*", "1 as g")
    every = all_rows.score(repeated, "p", ["label"]).selectExpr("*", "1 as g")
    got, expected = M.validation_metrics(once, "p", ["g"], copies="n").first(), M.validation_metrics(every, "p", ["g"]).first()
    assert got.n_items == 600 and got == expected
    # by name, whatever the order in which rows are packed
    turned = one.score(M.packed(rows, ["b", "x", "a"], ["n"]), "q", ["n"], ["b", "x", "a"])
    assert turned.agg({"q": "sum"}).first() == once.agg({"p": "sum"}).first()


def test_sites_of_a_place_are_scored_once_and_all_returned(spark):
    sites = spark.createDataFrame(
        [("a", "TSS", "chr1", 5, "+"), ("b", "TSS", "chr1", 5, "+"), ("a", "TES", "chr1", 5, "+"), ("c", "TSS", None, None, "+")],
        "transcript_id string, site_type string, chrom string, position long, strand string",
    )
    places = jobs.site_places(sites)
    assert sorted((r.site_type, r.position or 0, r.n) for r in places.collect()) == [("TES", 5, 1), ("TSS", 0, 1), ("TSS", 5, 2)]
    scores = places.selectExpr("site_type", "chrom", "position", "strand", "n / 4 as p_site_rf", "n / 2 as p_site_xgb")
    got = sorted((r.transcript_id, r.site_type, r.p_site_rf) for r in jobs.scored_sites(sites, scores).collect())
    assert got == [("a", "TES", 0.25), ("a", "TSS", 0.5), ("b", "TSS", 0.5), ("c", "TSS", 0.25)]


def test_exons_are_summed_once_for_all_assemblies(spark):
    tx = spark.createDataFrame(
        [("x", "t", "chr1", "+", 10, 90, 1.0), ("y", "t", "chr1", "-", 20, 80, 2.0), ("y", "u", "chr1", "+", 5, 9, 3.0)],
        "assembly_id string, transcript_id string, chrom string, strand string, start long, end long, coverage double",
    )
    exons = spark.createDataFrame([("t", 10, 19), ("t", 50, 90)], "transcript_id string, start long, end long")
    rows = transcripts.coverage_table(tx, exons, keep=["assembly_id"]).collect()
    got = {(r.assembly_id, r.transcript_id): (r.tss_pos, r.first_exon_length, r.last_exon_length, r.exon_count, r.coverage) for r in rows}
    assert got == {("x", "t"): (11, 10, 41, 2, 1.0), ("y", "t"): (80, 41, 10, 2, 2.0), ("y", "u"): (6, 0, 0, 0, 3.0)}


def test_places_are_predicted_once_for_all_transcripts(spark, monkeypatch):
    tx = spark.createDataFrame(
        [("t", "chr1", "+", 4, 90, 2.0), ("u", "chr1", "+", 4, 90, 9.0)], "transcript_id string, chrom string, strand string, start long, end long, coverage double"
    )
    cov = transcripts.coverage_table(tx, spark.createDataFrame([("t", 5, 9)], "transcript_id string, start long, end long"))
    packed = spark.createDataFrame(
        [("TSS", "chr1", 5, "+", 2, [1.0, 3.0]), ("TES", "chr1", 90, "+", 2, [0.0, 4.0])],
        f"site_type string, chrom string, position long, strand string, n long, {M.PACKED} array<double>",
    )
    monkeypatch.setattr(jobs, "known_places", lambda *_: (packed, ["a", "b"]))
    learn = spark.range(40).selectExpr("double(id % 2) as a", "int(id % 2) as label", "double(id % 2) * 10 as coverage", "double(id % 2) as b_tes")
    params = {"maxIter": 1, "maxDepth": 1, "minInstancesPerNode": 1}
    site = M.fit(learn, ["a"], kind="xgb", params=params)
    ranker = M.fit(learn, ["coverage"], kind="ranker", params=params)
    models = jobs.Models({(t, b): site for t in ("TSS", "TES") for b in jobs.BACKENDS}, {b: ranker for b in jobs.BACKENDS})
    scored, ranked = jobs.predict(tx, cov, None, models, jobs.JobConfig())
    sites = {(r.transcript_id, r.site_type): r.p_site_rf for r in scored.collect()}
    assert len(sites) == 4 and sites["t", "TSS"] == sites["u", "TSS"] > 0.5 > sites["t", "TES"] == sites["u", "TES"]
    got = {(r.transcript_id, r.backend): r.pred_label for r in ranked.collect()}
    assert got == {("t", "rf"): 0, ("t", "xgb"): 0, ("u", "rf"): 1, ("u", "xgb"): 1}
