"""Sequencing reads and alignments from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endsight.functions.reads import parse_cigar, reference_span
from endsight.sources.gtf import numbered_lines


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment rows from SAM text lines (``value``); a number that cannot be read is NULL."""
    cols = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("@")).withColumn("c", cols).where("size(c) >= 11")
    rows = body.selectExpr(
        "c[2] as chrom", "try_cast(c[3] as bigint) - 1 as ref_start", "try_cast(c[4] as int) as mapq",
        "(try_cast(c[1] as int) & 4) <> 0 as is_unmapped", "(try_cast(c[1] as int) & 16) <> 0 as is_reverse", "nullif(regexp_extract(value, '\\tts:A:(.)', 1), '') as ts",
        "nullif(c[5], '*') as cigar", "nullif(c[9], '*') as seq",
    )
    span = reference_span(parse_cigar(F.col("cigar")))
    return rows.withColumn("ref_end", F.when(F.col("cigar").isNotNull(), F.col("ref_start") + span))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments from a Parquet table, or from SAM text for ``.sam`` paths."""
    if ".sam" in path:
        return parse_sam(spark.read.text(path))
    return spark.read.parquet(path)


def fastq_records(lines: DataFrame) -> DataFrame:
    """FASTQ records of numbered lines (``file, number, value``) as ``file, record, read_id, seq, mate``.

    Lines before the first that starts with ``@`` are skipped; from there every four lines are a record.
    Head and sequence of a record meet in the task that read them; only records cut by a split travel as two rows.
    """
    starts = lines.where("value like '@%'").groupBy("file").agg(F.min("number").alias("_start"))
    placed = lines.join(starts, "file").where("number >= _start").selectExpr(
        "file", "(number - _start) div 4 as record", "(number - _start) % 4 as part", "value"
    )
    gathered = placed.where("part < 2").groupBy("file", "record").agg(
        F.expr("max(if(part = 0, value, null)) as head"), F.expr("max(if(part = 1, trim(value), null)) as seq")
    )
    mate = F.regexp_extract("file", r"[_.]R?([12])(?:_[0-9]+)?[.](?:fastq|fq)", 1)
    return gathered.where("seq is not null").select(
        "file", "record", F.regexp_extract("head", r"^@\s*(\S+)", 1).alias("read_id"), "seq", F.nullif(mate, F.lit("")).alias("mate")
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ records (plain or compressed) of files of any number of splits."""
    return fastq_records(numbered_lines(spark, path))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records as ``file, read_id, seq``."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_extract("value", r"^(\S+)", 1).alias("read_id"),
        F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"),
    )


def read_length_stats(lengths: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, minimum, maximum, floored mean and lengths by frequency (rarest first, longer first on ties).

    ``lengths`` has ``length``; every read counts.
    """
    per_length = lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("c"))
    # one entry per distinct length, not per read
    return per_length.groupBy(*by).agg(
        F.expr("sum(c) as reads"),
        F.expr("min(length) as min_length"),
        F.expr("max(length) as max_length"),
        F.expr("sum(length * c) div sum(c) as mean_length"),
        F.expr(
            "array_join(transform(array_sort(collect_list(struct(c, -length as neg))), x -> string(-x.neg)), ',') as lengths"
        ),
    )


def pair_files(files: DataFrame) -> DataFrame:
    """Mate files of a sample side by side from ``file`` and ``mate``."""
    stem = F.regexp_replace("file", r"([_.]R?)[12]((?:_[0-9]+)?[.](?:fastq|fq).*)$", "$1*$2")
    return (
        files.select("file", "mate", stem.alias("pair"))
        .groupBy("pair")
        .agg(
            F.expr("max(if(mate = '1', file, null)) as first_mate"),
            F.expr("max(if(mate = '2', file, null)) as second_mate"),
        )
    )
