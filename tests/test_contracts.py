"""Hand-checkable rows for the rules on names, attributes, sites and rankings."""

import re

import pytest
from pyspark.sql import functions as F

from endsight.functions import attributes as A
from endsight.functions.contigs import autosome_number, in_train_split, normalize_chrom
from endsight.functions.reads import parse_cigar, reference_span, splice_boundaries
from endsight.functions.sequences import kmers, reverse_complement
from endsight.operators import compare as C
from endsight.operators import ranking as K
from endsight.operators import runs as U
from endsight.operators import sites as S
from endsight.operators import transcripts as T

AUTOSOMES = {
    "chr1": 1, "CHR22": 22, "chrX": None, "chrM": None, "1": 1, "22": 22, "X": None, "NC_000001.11": 1,
    "NC_000010.11": 10, "NC_000022.11": 22, "NC_000023.11": None, "NC_012920.1": None, "chrNC_000001.11": 1,
    "NT_187361.1": None, "chrNT_187361.1": None, "NW_003315933.1": None, "NS_12345.1": None, "GL000191.1": None,
    "KI270733.1": None, "chrUn_KI270302v1": None,
}


def test_autosome_numbers(spark):
    df = spark.createDataFrame([(k,) for k in AUTOSOMES], "c string")
    got = {r["c"]: r["n"] for r in df.select("c", autosome_number(F.col("c")).alias("n")).collect()}
    assert got == AUTOSOMES


def test_split(spark):
    df = spark.createDataFrame([("1",), ("chr5",), ("GL000191.1",), ("15",), (None,)], "c string")
    got = [r[0] for r in df.select(in_train_split(F.col("c"), (1, 10))).collect()]
    assert got == [True, True, False, False, False]


def test_normalize_chrom(spark):
    df = spark.createDataFrame([("CHR1",), ("1",), ("",), ("chr",), (" X ",)], "c string")
    assert [r[0] for r in df.select(normalize_chrom(F.col("c"))).collect()] == ["chr1", "chr1", "", "chrchr", "chrX"]


def test_candidate_sites(spark):
    tx = spark.createDataFrame(
        [("a", "chr1", "+", 100, 500), ("b", "chr1", "-", 100, 500), ("c", "chr1", ".", 100, 500), ("d", "chr1", "?", 1, 2)],
        "transcript_id string, chrom string, strand string, start bigint, end bigint",
    )
    got = {(r.transcript_id, r.site_type, r.strand): r.position for r in S.candidate_sites(tx).collect()}
    assert got == {
        ("a", "TSS", "+"): 101, ("a", "TES", "+"): 500, ("b", "TSS", "-"): 500, ("b", "TES", "-"): 101,
        ("c", "TSS", "+"): 101, ("c", "TES", "+"): 500, ("c", "TSS", "-"): 500, ("c", "TES", "-"): 101,
    }


def test_attributes(spark):
    rows = ['gene_id "g"; transcript_id "t"; mycoverage "9"; coverage "1.5"; cov "2";', "x 1", "a=b; c d; a=e", ""]
    df = spark.createDataFrame([(r,) for r in rows], "attrs string")
    a = F.col("attrs")
    out = df.select(
        A.coverage_value(a).alias("v"), A.set_coverage(a, F.lit(0.5)).alias("s"), A.attributes_map(a).alias("m")
    ).collect()
    assert [r["v"] for r in out] == [1.5, 0.0, 0.0, 0.0]
    assert out[0]["s"] == rows[0].replace('cov "2"', 'cov "0.5"')
    assert out[1]["s"] == 'x 1; cov "0.5";' and out[3]["s"] == 'cov "0.5";'
    assert out[2]["m"] == {"a": "e", "c": "d"} and out[0]["m"]["mycoverage"] == "9"


def test_attributes_map_reads_a_line_once(spark):
    """entries by their patterns on odd lines, and the line is split once."""
    rows = [
        'gene_id "g"; transcript_id "t 1"; note ""; note "last"', "a=b; c d e; a=e;; k = v =w ; x", 'a\t"b"c; b  "d ; e "=f"; "g" h',
        '\tz y; q\t; r "s', 'p="1"; p2 ="2"; m n="o"; m "x=y"; u "v" w', 'n "1\n2"; n\n3; ä "ö"; o ""x"', "", " ; ;", None,
    ]

    def expected(line):
        if line is None:
            return None
        out = {}
        for part in filter(None, (p.strip(" ") for p in line.split(";"))):
            if "=" in part and not re.match(r'\S+\s+"', part, re.ASCII):
                key, value = (x.strip(" ") for x in part.split("=", 1))
            else:
                found = re.match(r'(\S+)\s+"([^"]*)"', part, re.ASCII)
                bare = re.match(r"(\S+)\s+(\S+)", part, re.ASCII)
                key, value = found.groups() if found else (bare[1], bare[2].strip('"')) if bare else ("", "")
            if key:
                out.pop(key, None)
                out[key] = value
        return out

    df = spark.createDataFrame([(r,) for r in rows], "attrs string").select("attrs", A.attributes_map(F.col("attrs")).alias("m"))
    assert [r["m"] for r in df.collect()] == [expected(r) for r in rows]
    assert df._jdf.queryExecution().analyzed().toString().count("split(attrs") == 1


def test_reads(spark):
    df = spark.createDataFrame([("5S10M2I100N3D7M4S", 1000)], "cigar string, ref_start bigint")
    parsed = df.withColumn("ops", parse_cigar(F.col("cigar")))
    row = parsed.select(
        reference_span(F.col("ops")).alias("span"), splice_boundaries(F.col("ops"), F.col("ref_start")).alias("b")
    ).first()
    assert row["span"] == 10 + 100 + 3 + 7 and row["b"] == [1017, 1117]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGNTTTA",)], "s string")
    row = df.select(kmers(F.col("s"), 3).alias("k"), reverse_complement(F.col("s")).alias("r")).first()
    assert row["k"] == ["ACG", "TTT", "TTA"] and row["r"] == "TAAANCGT"


def test_ranked_cov_tmap(spark):
    ranked = spark.createDataFrame([("a", 0.9), ("b", 0.7), ("c", 0.4), ("d", 0.1)], "transcript_id string, pred_prob double")
    cov = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("c", 10.0), ("d", 1.0)], "transcript_id string, coverage double")
    lab = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("d", 0)], "transcript_id string, label int")
    joined = T.ranked_cov_labels(ranked, cov, lab).selectExpr("label", "stack(2, 'm', pred_prob, 'b', coverage) as (curve, s)")
    rows = K.average_precision(joined, by=["curve"], label="label", score="s").collect()
    assert {(r.n_positive, r.aupr) for r in rows} == {(2, 1.0)} and len(rows) == 2


def test_ordered_summary(spark):
    df = spark.createDataFrame([("x", 1.0, "ok", "t")], "zzz string, stage2_test_aupr_rf double, status string, test_id string")
    assert C.ordered_summary(df).columns == ["test_id", "status", "stage2_test_aupr_rf"]


def test_matrix_expand(spark):
    asm = "array<struct<assembler_id:string,gtf:string,tmap:string>>"
    rows = [
        ("r", "m", s, "b", "g", [("isoquant", "i.gtf", "i.tmap"), ("StringTie", "s.gtf", "s.tmap"), ("x", "x.gtf", None)])
        for s in ("train", "s1")
    ]
    df = spark.createDataFrame(rows, f"ref_id string, modality string, sample_id string, bam string, ref_gtf string, assemblies {asm}")
    got = U.expand_tests(df, "train").orderBy("assembler_order").collect()
    assert [r.test_id for r in got] == ["s1__stringtie", "s1__isoquant"]
