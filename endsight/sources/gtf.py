"""Annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from endsight.functions.attributes import coverage_value, quoted_attribute


def line_order() -> Column:
    """An ordinal that follows the order of the lines of one file.

    Rows within a split come in line order and splits of a file are numbered by their place, so the value grows along a
    file; it has gaps, and values of several files may interleave (see ``numbered_lines``).
    """
    return F.monotonically_increasing_id()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``file, number, value``, numbered from 0 within each file.

    Lines are counted per split of a file (the block a task reads), the counts are summed along the splits, and each line adds
    its place in its split.  The text is neither sorted, shuffled for its order nor written; what travels is one row per split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    splits = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = "coalesce(sum(_n) over (partition by file order by _block rows between unbounded preceding and 1 preceding), 0)"
    offsets = splits.selectExpr("file", "_block", f"_first - {before} as _from")
    return lines.join(offsets, ["file", "_block"]).selectExpr("file", "_at - _from as number", "value")


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Split annotation lines (``line_no, value``) into columns.

    Lines with fewer than nine columns and comments keep their text and get NULL
    fields; unreadable coordinates become NULL.
    """
    cols = F.split("value", "\t")
    data = ~F.col("value").startswith("#") & (F.size(cols) >= 9)

    def field(i: int) -> Column:
        return F.when(data, F.get(cols, F.lit(i)))

    keep = [c for c in lines.columns if c not in ("line_no", "value")]
    split = lines.select(
        *keep, "line_no", "value", F.size(cols).alias("n_columns"),
        field(0).alias("chrom"), field(1).alias("source"), field(2).alias("feature"),
        field(3).try_cast("bigint").alias("start"), field(4).try_cast("bigint").alias("end"),
        field(5).alias("score"), field(6).alias("strand"), field(7).alias("frame"), field(8).alias("attrs"),
    )
    return split.withColumns(
        {
            "transcript_id": quoted_attribute(F.col("attrs"), "transcript_id"),
            "gene_id": quoted_attribute(F.col("attrs"), "gene_id"),
        }
    )


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines of one or more annotation files with parsed columns and ``file``."""
    lines = spark.read.text(path).select(
        line_order().alias("line_no"), F.col("_metadata.file_path").alias("file"), "value"
    )
    return parse_gtf(lines)


def gtf_transcripts(lines: DataFrame) -> DataFrame:
    """Transcript rows with coverage."""
    keep = [c for c in ("assembler_id", "sample", "file") if c in lines.columns]
    rows = lines.where(
        "feature = 'transcript' and transcript_id is not null and start is not null and end is not null"
    )
    return rows.select(
        *keep, "line_no", "transcript_id", "gene_id", "chrom", "strand", "start", "end",
        coverage_value(F.col("attrs")).alias("coverage"),
    )


def gtf_exons(lines: DataFrame) -> DataFrame:
    """Exon rows with a transcript id and coordinates."""
    return lines.where(
        "feature = 'exon' and transcript_id is not null and start is not null and end is not null"
    ).select("line_no", "transcript_id", "chrom", "strand", "start", "end")


def write_lines(lines: DataFrame, path: str, *, order: tuple[str, ...] = ("line_no",)) -> None:
    """Write ``value`` as text in the given order."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)
