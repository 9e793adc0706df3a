"""Tab- and comma-separated tables, match files, manifests and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endsight.operators.compare import RUN_PATTERN, auc_table, parse_run_id
from endsight.sources.gtf import line_order, numbered_lines

# Schemas of the exchanged tables.
COV_SCHEMA = (
    "transcript_id string, strand string, tss_chrom string, tes_chrom string, tss_pos bigint, tes_pos bigint,"
    " coverage double, first_exon_length bigint, last_exon_length bigint, max_exon_length bigint,"
    " min_exon_length bigint, mean_exon_length double, total_exon_length bigint, exon_count bigint"
)
SCORED_SCHEMA = (
    "site_id string, transcript_id string, site_type string, chrom string, position bigint, strand string,"
    " p_site_rf double, p_site_xgb double"
)
RANKED_SCHEMA = "transcript_id string, pred_prob double, pred_label int, label int"
MANIFEST_SCHEMA = (
    "schema_version string, bundle_id string, sample_id string, ref_id string, genome_fasta string,"
    " ref_annotation_gtf string, alignments struct<sorted_bam string, bam_index string, aligner string>,"
    " assemblies array<struct<assembler_id string, gtf string,"
    " gffcompare struct<tmap string, refmap string, stats string, prefix string>>>"
)


def _typed(df: DataFrame, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Cast the columns named in ``schema`` that are present; fail when a required one is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    types = dict(part.strip().split(" ", 1) for part in schema.split(", "))
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) for c in df.columns if c in types])


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, comment="#")


def read_cov(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_tsv(spark, path), COV_SCHEMA, ("transcript_id", "coverage"))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    need = ("site_type", "chrom", "position", "strand", "p_site_rf", "p_site_xgb")
    return _typed(_tsv(spark, path), SCORED_SCHEMA, need)


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_tsv(spark, path), RANKED_SCHEMA, ("transcript_id", "pred_prob"))


def tmap_labels(df: DataFrame) -> DataFrame:
    """Match table to ``transcript_id, label, ref_id, class_code``."""
    missing = [c for c in ("qry_id", "class_code") if c not in df.columns]
    if missing:
        raise ValueError(f"match table lacks {missing}")
    ref = F.col("ref_id") if "ref_id" in df.columns else F.lit("")
    return df.select(
        F.col("qry_id").alias("transcript_id"),
        F.coalesce(F.col("class_code") == "=", F.lit(False)).cast("int").alias("label"),
        ref.alias("ref_id"),
        "class_code",
    )


def read_tmap(spark: SparkSession, path: str) -> DataFrame:
    return tmap_labels(_tsv(spark, path))


def tmap_items(lines: DataFrame) -> DataFrame:
    """Positional match rows from text lines (``row_no, value``).

    Lines with fewer than ten tab fields are split on blanks; headers and rows with
    unreadable numbers are dropped.
    """
    tabs, blanks = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
    usable = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    # filters stay above an explode; below, each of them would split the line again
    p = usable.select("row_no", F.explode(F.array(F.when(F.size(tabs) >= 10, tabs).otherwise(blanks))).alias("p")).where("size(p) >= 10")
    return p.where("p[0] <> 'ref_gene_id'").selectExpr(
        "row_no", "p[1] as ref_id", "if(p[2] = '', '@', left(p[2], 1)) as class_code",
        "try_cast(p[6] as double) as fpkm", "try_cast(p[7] as double) as tpm", "try_cast(p[8] as double) as cov",
        "int(try_cast(p[9] as double)) as length",
    ).where("fpkm is not null and tpm is not null and cov is not null and length is not null")


def read_tmap_items(spark: SparkSession, path: str) -> DataFrame:
    return tmap_items(spark.read.text(path).select(line_order().alias("row_no"), "value"))


def tsstes_lines(lines: DataFrame) -> DataFrame:
    """Five-token site count lines to ``site_type, chrom, position, plus, minus``."""
    return (
        lines.withColumn("t", F.split(F.trim("value"), r"\s+"))
        .where("size(t) >= 5 and t[0] in ('TSS', 'TES')")
        .selectExpr(
            "t[0] as site_type", "t[1] as chrom", "try_cast(t[2] as bigint) as position",
            "try_cast(t[3] as bigint) as plus", "try_cast(t[4] as bigint) as minus",
        )
        .where("position is not null and plus is not null and minus is not null")
    )


def predictions(rows: DataFrame) -> DataFrame:
    """Id/score rows (``row_no, id, raw``) to one score per transcript; the last readable row wins."""
    usable = rows.selectExpr("row_no", "trim(id) as transcript_id", "try_cast(raw as double) as score")
    return (
        usable.where("score is not null and transcript_id <> ''")
        .groupBy("transcript_id")
        .agg(F.max_by("score", "row_no").alias("score"))
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(line_order().alias("row_no"), F.split("value", "\t").alias("c"))
    return predictions(lines.where("size(c) >= 2").selectExpr("row_no", "c[0] as id", "c[1] as raw"))


def chrom_list(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("chrom")).where("chrom <> ''").distinct()


def read_chroms(spark: SparkSession, path: str) -> DataFrame:
    return chrom_list(spark.read.text(path))


def manifest_rows(texts: DataFrame) -> DataFrame:
    """JSON manifests (``path, value``) as ``ref_id, modality, sample_id, bam, ref_gtf, assemblies, problem``.

    The first three come from the path ``<ref>/<modality>/<sample>/<file>``.  A manifest that is no JSON object, or lacks
    ``alignments.sorted_bam`` or ``ref_annotation_gtf``, has its ``problem`` named; one without assemblies has an empty list.
    """
    parsed = texts.withColumn("m", F.from_json("value", MANIFEST_SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    key = "regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)/[^/]+$', {})"
    return parsed.selectExpr(
        f"{key.format(1)} as ref_id", f"{key.format(2)} as modality", f"{key.format(3)} as sample_id",
        "m.alignments.sorted_bam as bam", "m.ref_annotation_gtf as ref_gtf",
        """coalesce(transform(m.assemblies, a -> named_struct('assembler_id', a.assembler_id, 'gtf', a.gtf, 'tmap', a.gffcompare.tmap)),
          cast(array() as array<struct<assembler_id:string,gtf:string,tmap:string>>)) as assemblies""",
        """case when m is null or m._broken is not null then 'not an object' when m.alignments.sorted_bam is null then 'alignments.sorted_bam'
          when m.ref_annotation_gtf is null then 'ref_annotation_gtf' end as problem""",
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """JSON manifests under ``<ref>/<modality>/<sample>/``, one file each."""
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return manifest_rows(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


def _fields(column: str) -> str:
    """Comma-separated fields of a line; quoted ones may hold commas and doubled quotes."""
    parts = f"split({column}, ',(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)', -1)"
    plain = "regexp_replace(trim(f), '^\"(.*)\"$', '$1')"
    return f"transform({parts}, f -> replace({plain}, '\"\"', '\"'))"


def summary_rows(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Run summaries of possibly different columns, from numbered lines (``file, number, value``), by column name.

    Line 0 of a file is its header; it is joined to the file's rows, which become maps from name to value.  ``columns``
    are those of the result; by default all names of all headers, in order (reading the distinct names runs a job whose result
    is as large as one header).  Absent and empty values are NULL; the run comes from ``<run>/reports/<file>``, and
    files of other runs are left out.  Fields do not span lines.
    """
    run = F.regexp_extract("file", r"([^/]+)/reports/[^/]+$", 1)
    named = lines.where("trim(value) <> ''").withColumn("run_id", run).where(F.col("run_id").rlike(RUN_PATTERN))
    heads = named.where("number = 0").selectExpr("file", f"{_fields('value')} as _head")
    if columns is None:
        columns = [r[0] for r in heads.selectExpr("explode(_head) as name").where("name <> ''").distinct().orderBy("name").collect()]
    rows = named.where("number > 0").selectExpr("file", "run_id", f"{_fields('value')} as _values").join(heads, "file")
    # of equal names the first counts
    mapped = rows.selectExpr(
        "run_id",
        "map_from_arrays(array_distinct(_head), transform(array_distinct(_head), h -> nullif(get(_values, int(array_position(_head, h)) - 1), ''))) as _map",
    )
    picked = mapped.select("run_id", *[F.col("_map")[c].alias(c) for c in columns])
    return picked.withColumns(parse_run_id(F.col("run_id")))


def read_summaries(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Run summaries ``<run_id>/reports/*.csv`` as one frame (see ``summary_rows``)."""
    return summary_rows(numbered_lines(spark, pattern), columns)


def read_auc_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=False, schema="label string, auc string")
    return auc_table(raw.where("lower(trim(label)) <> 'label'"))


def read_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """Long ``metric,value`` files with their file name."""
    raw = spark.read.csv(path, header=True, quote='"', schema="metric string, value string")
    return raw.withColumn("file", F.col("_metadata.file_path"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows in file order."""
    return spark.read.csv(path, header=True).withColumn("row_no", line_order())


def write_tsv(df: DataFrame, path: str, *, order: tuple = ()) -> None:
    """Tab-separated with header, optionally sorted."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def bed_lines(rows: DataFrame) -> DataFrame:
    """Rows as tab-separated text in column order."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
