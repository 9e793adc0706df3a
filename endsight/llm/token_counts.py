"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A change is an insert, a delete or a revision of one document's count.  It becomes signed
rows: +1 document and +n tokens, -1 and -n, or both for a revision (which may also move a document to another key).  Signed rows
are summed per key, first within each task and then across tasks, so a hot key
travels as one row per task.  Every attempt to commit a batch
writes its sums to a folder of its own; then a small file that names the attempt gets the batch's name in one step,
which fails if another attempt has it.  Totals read only attempts that such a file names, so repeated, restarted and
racing commits count once.

Defined cases: a null text has no tokens; a null source, language or version is a key of its own; a
null count is 0; repeated rows count as often as they occur; keys whose documents and
tokens all cancel are left out; with no batch, or only empty ones, there are no totals.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")

#: Tokenizer versions that Spark counts itself: a pattern whose matches are the tokens.
VERSIONS = {
    "words": r"[^\x20\x09-\x0D]+",
    "pieces": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+",
    "letters": r"\p{L}+",
}


def count_tokens(text: str, version: str) -> str:
    """SQL for the number of tokens of column ``text`` under ``version``."""
    pattern = VERSIONS[version].replace("\\", "\\\\")
    return f"bigint(coalesce(regexp_count({text}, '{pattern}'), 0))"


def changes(
    df: DataFrame, kind: str, *, new: str | None = None, old: str | None = None, version: str, doc: str = "*"
) -> DataFrame:
    """Changes of one kind; ``new`` and ``old`` are SQL for the counts after and before."""
    side = "named_struct('source', source, 'lang', lang, 'tokenizer_version', '{v}', 'n_tokens', bigint({n}))"
    none = "cast(null as struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint>)"
    before = side.format(v=version, n=old) if old else none
    after = side.format(v=version, n=new) if new else none
    return df.selectExpr(f"'{kind}' as kind", f"{before} as before", f"{after} as after")


def signed(change: DataFrame) -> DataFrame:
    """One signed sum per key; changes have columns ``before`` and ``after`` (null where there is none)."""
    sides = change.selectExpr(
        "explode(array(struct(before as side, -1L as sign), struct(after as side, 1L as sign))) as x"
    ).where("x.side is not null")
    return (
        sides.selectExpr("x.side.*", "x.sign")
        .groupBy(*KEYS)
        .agg(
            F.sum("sign").alias("docs"),
            F.expr("sum(sign * coalesce(n_tokens, 0))").alias("tokens"),
        )
    )


class TokenRollup:
    """Committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Add a batch; False if a batch of this name is already committed.

        The name should be the same whenever the same changes are sent again.
        """
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"batch name {batch!r}: use letters, digits, - and _")
        fs, marker = self._fs(f"{self.folder}/committed/{batch}")
        if fs.exists(marker):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        signed(change).write.parquet(f"{self.folder}/data/attempt={attempt}")
        fs.mkdirs(marker.getParent())
        _, aside = self._fs(f"{self.folder}/writing/{attempt}")
        out = fs.create(aside, True)
        out.writeBytes(attempt)
        out.close()
        if self._claim(fs, aside, marker):
            return True
        # another committer came first; its attempt counts
        fs.delete(aside, False)
        fs.delete(self._fs(f"{self.folder}/data/attempt={attempt}")[1], True)
        return False

    def _claim(self, fs, aside, marker) -> bool:
        """Give the written marker its final name unless there is one, in one step of the file system."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        context = hadoop.FileContext.getFileContext(marker.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(marker), overwrite)
        except Py4JJavaError:
            if fs.exists(marker):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """Sums over the attempts that a marker names; others were never committed."""
        fs, committed = self._fs(f"{self.folder}/committed")
        schema = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint"
        if not fs.exists(committed):
            return self.spark.createDataFrame([], schema)
        named = self.spark.read.text(f"{self.folder}/committed").withColumnRenamed("value", "attempt")
        rows = self.spark.read.schema(f"{schema}, attempt string").parquet(f"{self.folder}/data")
        rows = rows.join(named, "attempt", "left_semi")
        return (
            rows.groupBy(*KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 or tokens <> 0")
        )
