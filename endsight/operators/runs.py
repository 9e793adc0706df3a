"""Bundle manifests: which assemblies are evaluated, against which files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Assemblers in evaluation order.
ASSEMBLER_ORDER = ("stringtie", "isoquant", "scallop2")


def assembler_rank(assembler: Column) -> Column:
    """Position in the evaluation order; unknown assemblers come last."""
    at = F.array_position(F.array(*[F.lit(a) for a in ASSEMBLER_ORDER]), assembler).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(ASSEMBLER_ORDER))


def expand_tests(manifests: DataFrame, train_sample: str) -> DataFrame:
    """One test per sample and assembler that has a match table, without the training sample.

    Repeated assemblers of a sample keep their first entry.
    """
    entries = manifests.where(F.col("sample_id") != train_sample).select(
        "ref_id", "modality", "sample_id", "bam", "ref_gtf", F.posexplode("assemblies").alias("_i", "a")
    )
    named = entries.select(
        "ref_id", "modality", "sample_id", "bam", "ref_gtf", "_i",
        F.lower(F.trim("a.assembler_id")).alias("assembler_id"), F.col("a.gtf").alias("gtf"), F.col("a.tmap").alias("tmap"),
    ).where("assembler_id <> '' and gtf is not null and tmap is not null")
    keys = ["ref_id", "modality", "sample_id", "assembler_id"]
    first = named.groupBy(*keys).agg(F.min(F.struct("_i", "bam", "ref_gtf", "gtf", "tmap")).alias("f"))
    return first.select(
        F.concat_ws("__", "sample_id", "assembler_id").alias("test_id"), *keys,
        "f.bam", "f.gtf", "f.ref_gtf", "f.tmap", assembler_rank(F.col("assembler_id")).alias("assembler_order"),
    )


def latest_ok(index: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Rows of an index with status ``ok`` and non-empty keys; the last row of a key wins."""
    usable = index.where(F.lower(F.trim("status")) == "ok")
    for c in [*keys, value]:
        usable = usable.where(F.trim(F.coalesce(c, F.lit(""))) != "")
    return usable.groupBy(*keys).agg(F.max_by(F.trim(value), order).alias(value))


def override_paths(tests: DataFrame, refs: DataFrame, tmaps: DataFrame) -> DataFrame:
    """Replace ``ref_gtf`` and ``tmap`` by the looked-up files; ``missing`` names absent keys."""
    r = refs.selectExpr("ref_id", "modality", "sample_id", "out_gtf as _r")
    t = tmaps.selectExpr("ref_id", "modality", "sample_id", "assembler_id", "tmap_path as _t")
    joined = tests.join(r, ["ref_id", "modality", "sample_id"], "left").join(
        t, ["ref_id", "modality", "sample_id", "assembler_id"], "left"
    )
    return joined.withColumns(
        {
            "ref_gtf": F.coalesce("_r", "ref_gtf"),
            "tmap": F.coalesce("_t", "tmap"),
            "missing": F.expr("case when _r is null then 'ref_gtf' when _t is null then 'tmap' end"),
        }
    ).drop("_r", "_t")
