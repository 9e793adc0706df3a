"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's own setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder.rstrip("/")


def vocabulary() -> str:
    """Path of the public word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Rows and bytes of an Arrow batch, unless the session sets its own: texts are long, and a
#: batch stands several times in a task's memory.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def small_batches(spark: SparkSession) -> None:
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


#: Spark's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder, with the shuffle files behind them removed.

    For steps whose shuffles are large and whose result is small.
    """
    from endsight.operators.scale import cut_lineage

    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df.select("*"))  # the setting holds for plans made under it
    finally:
        conf.set(CLEANUP, before)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns most operators need, as ``_id`` (bigint) and ``_text`` (string)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the identifier written as text, modulo ``modulus``; a null counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def numbered(df: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Add ``_row``, a gapless number from 0 in ``order`` within ``group``, and ``_rows``, the group's size.

    The rows are cut into ranges of (group, order), sorted inside each range and written
    once to the shared folder, so that later steps see the same ranges even if an
    executor is lost.  ``monotonically_increasing_id`` then holds range and place; one
    row per range and group carries what came before.  Neither a group nor one value of
    ``order`` has to fit one task: the last sort key is the row's place in its input,
    which only decides between rows equal in all of ``order``.
    """
    from endsight.operators.scale import cut_lineage

    group = group or []
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order, F.col("_place").asc()]
    ranged = cut_lineage(
        placed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_place")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.expr("shiftright(_at, 33)"))
    )
    # rows of a group lie side by side in a range, so its first place there is the offset
    parts = ranged.groupBy("_range", *group).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    names = ", ".join(f"`{c}`" for c in group) or "1"
    same = " and ".join(["r._range = p._range", *[f"r.`{c}` <=> p.`{c}`" for c in group]])
    counted = parts.selectExpr(
        "*",
        f"coalesce(sum(_n) over (partition by {names} order by _range rows between unbounded preceding and 1 preceding), 0) as _before",
        f"sum(_n) over (partition by {names}) as _rows",
    )
    return (
        ranged.alias("r")
        .join(counted.alias("p"), F.expr(same), "left")
        .selectExpr(*[f"r.`{c}`" for c in df.columns], "r._at - p._first + p._before as _row", "p._rows as _rows")
    )


def owned_rows(docs: DataFrame, winners: DataFrame, key: Column, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` named by ``winners`` (``_own, _own_key, _copies``), each once, with all columns.

    ``key`` is the key of a row of ``docs`` aliased ``d``.  Of several rows equal in identifier and key the one with the
    longest text stays.
    """
    rows = docs.alias("d").select(
        F.struct("d.*").alias("_row"),
        F.col(f"d.{doc_id}").cast("bigint").alias("_id"),
        F.coalesce(F.length(F.col(f"d.{text}").cast("string")), F.lit(-1)).alias("_chars"),
        key.alias("_key"),
    )
    chosen = rows.join(winners, F.expr("_id <=> _own and _key = _own_key"))
    once = chosen.where("_copies = 1").select("_row")
    several = (
        chosen.where("_copies > 1")
        .groupBy("_own", "_own_key")
        .agg(F.max_by("_row", "_chars").alias("_row"))
        .select("_row")
    )
    return once.unionByName(several).select("_row.*")


def rows_out(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows and about ``limit`` bytes of text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= limit:
            yield batch_of(held, schema)
            held, weight = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
    )
