"""Text sources and sinks on small files."""

import gzip
import json

from pyspark.sql import functions as F

from endsight.operators import annotation as N
from endsight.operators import models as M
from endsight.sources import gtf as G
from endsight.sources import reads as R
from endsight.sources import tables as TB

GTF = """# header
chr1\ta\tgene\t100\t500\t.\t+\t.\tgene_id "g1";
chr1\ta\ttranscript\t100\t500\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; cov "3.5";
chr1\ta\texon\t100\t200\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
chr2\ta\ttranscript\t5\tbad\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
short line
"""


def test_gtf_round_trip(spark, tmp_path):
    src = tmp_path / "a.gtf"
    src.write_text(GTF)
    lines = G.read_gtf(spark, str(src))
    assert lines.count() == 6
    tx = G.gtf_transcripts(lines).collect()
    assert [(r.transcript_id, r.coverage) for r in tx] == [("t1", 3.5)]
    ranked = spark.createDataFrame([("t1", 0.9), ("t2", 0.1)], "transcript_id string, pred_prob double")
    kept = N.filter_by_score(lines, ranked, 0.5)
    G.write_lines(kept, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text == "\n".join(x for x in GTF.strip().split("\n") if "t2" not in x)


def test_fastq_and_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "s_R1.fastq.gz", "wt") as f:
        f.write("".join(f"@r{i} x\n{'ACGT' * (i + 1)}\n+\n{'@' * 4 * (i + 1)}\n" for i in range(5)))
    got = {r.read_id: (r.seq, r.mate) for r in R.read_fastq(spark, str(tmp_path / "*.fastq.gz")).collect()}
    assert got == {f"r{i}": ("ACGT" * (i + 1), "1") for i in range(5)}
    (tmp_path / "x.fa").write_text(">a d\nAC\nGT\n>b\nTT\n")
    assert sorted((r.read_id, r.seq) for r in R.read_fasta(spark, str(tmp_path / "x.fa")).collect()) == [("a", "ACGT"), ("b", "TT")]


def test_fastq_of_many_splits(spark, tmp_path):
    seqs = {f"r{i}": "ACGT" * (1 + i % 7) for i in range(3000)}
    for part in range(2):
        names = list(seqs)[part::2]
        (tmp_path / f"s_R{part + 1}.fastq").write_text("odd line\n" * part + "".join(f"@{n} x\n{seqs[n]}\n+\n@{'I' * 9}\n" for n in names))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = G.numbered_lines(spark, str(tmp_path / "*.fastq"))
        assert lines.rdd.getNumPartitions() > 4
        numbers = lines.groupBy("file").agg(F.min("number"), F.max("number"), F.count_distinct("number")).collect()
        assert sorted(tuple(r)[1:] for r in numbers) == [(0, 5999, 6000), (0, 6000, 6001)]
        got = R.read_fastq(spark, str(tmp_path / "*.fastq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.read_id: r.seq for r in got} == seqs and len(got) == 3000
    assert {r.mate for r in got} == {"1", "2"}


def test_broken_manifests_are_named(spark):
    texts = [("/b/g/sr/S1/m", "[1]"), ("/b/g/sr/S2/m", "{"), ("/b/g/sr/S3/m", "{}"), ("/b/g/sr/S4/m", '{"alignments": {"sorted_bam": "b"}, "ref_annotation_gtf": "r"}')]
    rows = {r.sample_id: r for r in TB.manifest_rows(spark.createDataFrame(texts, "path string, value string")).collect()}
    assert [rows[k].problem for k in ("S1", "S2", "S3", "S4")] == ["not an object", "not an object", "alignments.sorted_bam", None]
    assert rows["S4"].assemblies == [] and rows["S4"].bam == "b"


def test_saved_model_knows_its_features(spark, tmp_path):
    rows = spark.range(60).selectExpr("double(id) as a", "double(id % 7) as b", "int(id > 30) as label", "id as position")
    model = M.fit(rows, M.feature_names(rows), kind="rf", params={"numTrees": 3, "maxDepth": 3})
    assert model.features == ["a", "b"]
    model.save(str(tmp_path / "m"), spark)
    again = M.Classifier.load(str(tmp_path / "m"), spark)
    other = rows.selectExpr("label", "b", "a", "a * 2 as c")
    assert again.contract(other) == ([], ["c"]) and again.contract(other.drop("a")) == (["a"], ["c"])
    scores = lambda m, df: [r.p for r in m.score(df, "p", keep=["b"]).collect()]
    assert scores(model, rows) == scores(again, other)
    assert scores(again, other.drop("a")) == scores(again, other.withColumn("a", F.lit(0.0)))


def test_read_length_order(spark):
    df = spark.createDataFrame([(5,), (5,), (7,), (9,)], "length int")
    row = R.read_length_stats(df).first()
    assert (row.reads, row.min_length, row.max_length, row.mean_length, row.lengths) == (4, 5, 9, 6, "9,7,5")


def test_sam(spark):
    line = "r\t16\tchr1\t101\t60\t3S10M5N7M\t*\t0\t0\tACG\t*\tts:A:-"
    row = R.parse_sam(spark.createDataFrame([("@HD",), (line,)], "value string")).first()
    assert (row.ref_start, row.ref_end, row.is_reverse, row.ts) == (100, 122, True, "-")


def test_manifests_and_summaries(spark, tmp_path):
    d = tmp_path / "m" / "gencode" / "sr" / "S1"
    d.mkdir(parents=True)
    body = {"sample_id": "S1", "ref_annotation_gtf": "r.gtf", "alignments": {"sorted_bam": "b"}, "assemblies": [{"assembler_id": "stringtie", "gtf": "g", "gffcompare": {"tmap": "t"}}]}
    (d / "manifest.json").write_text(json.dumps(body))
    row = TB.read_manifests(spark, str(tmp_path / "m")).first()
    assert (row.ref_id, row.modality, row.sample_id, row.assemblies[0].tmap) == ("gencode", "sr", "S1", "t")
    for run, text in {"sr__train_a__test_b": "test_id,x\nT,1\n", "sr__train_a__test_c__v2": "test_id,y\nT,2\n"}.items():
        (tmp_path / run / "reports").mkdir(parents=True)
        (tmp_path / run / "reports" / "s.csv").write_text(text)
    got = TB.read_summaries(spark, str(tmp_path / "*" / "reports" / "s.csv")).collect()
    assert sorted((r.test_annotation, r.run_variant, r.x, r.y) for r in got) == [("b", "", "1", None), ("c", "v2", None, "2")]


def test_tables(spark, tmp_path):
    TB.write_tsv(spark.createDataFrame([("1", 0.5)], "transcript_id string, pred_prob double"), str(tmp_path / "r"), order=(F.desc("pred_prob"),))
    assert TB.read_ranked(spark, str(tmp_path / "r")).dtypes == [("transcript_id", "string"), ("pred_prob", "double")]
    (tmp_path / "p.tsv").write_text("transcript_id\tscore\na\t0.5\na\t0.7\nb\tbad\n")
    assert [tuple(r) for r in TB.read_predictions(spark, str(tmp_path / "p.tsv")).collect()] == [("a", 0.7)]
