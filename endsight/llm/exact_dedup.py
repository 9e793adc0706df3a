"""Exact deduplication with owners in Patricia tries.

Texts are equal when they are the same bytes once blanks are deleted.  Each input
task inserts its full byte strings into a compressed radix trie, so copies within a
task meet before anything travels; the distinct strings then go to partitions by
length and content hash, where tries merge them.  A terminal node stores the count and
the owner: most code points in the original text, then the smallest identifier.  A trie
that outgrows its budget gives up its heaviest subtree: the subtree's owners go
out as partial rows, which the closing aggregation by (length, hash) joins up again.

Defined cases: a null text counts as empty, and empty texts are copies of each other; a
null identifier loses to any other; of rows equal in identifier and text one stays.
Other columns are carried, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import BLANKS, keyed, owned_rows, rows_out

_DELETE = BLANKS.encode()
#: Bytes of text that one trie may hold before it spills a subtree.
TRIE_BYTES = 32 << 20

_DIGEST = pa.schema([("_id", pa.int64()), ("_chars", pa.int64()), ("_length", pa.int64()), ("_sha", pa.string())])
_OWNER = pa.schema(
    [
        ("_length", pa.int64()),
        ("_sha", pa.string()),
        ("_bytes", pa.binary()),
        ("_short", pa.int64()),
        ("_no_id", pa.bool_()),
        ("_id", pa.int64()),
        ("_count", pa.int64()),
    ]
)
_DDL = "_length bigint, _sha string, _bytes binary, _short bigint, _no_id boolean, _id bigint, _count bigint"


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving: long equal runs compare as blocks."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie from byte strings to (owner, count).

    A node is ``[label, children by first byte, value or None]``; owners are tuples of
    which the smallest wins.
    """

    def __init__(self) -> None:
        self.root = [b"", {}, None]
        self.weights: dict[int | None, int] = {}

    @property
    def weight(self) -> int:
        return sum(self.weights.values())

    def insert(self, key: bytes, owner: tuple, count: int) -> None:
        node, rest, added = self.root, key, 0
        while rest:
            child = node[1].get(rest[0])
            if child is None:
                node[1][rest[0]] = child = [rest, {}, None]
                added += len(rest) + 200
                node, rest = child, b""
                break
            label = child[0]
            shared = len(label) if rest.startswith(label) else shared_prefix(rest, label)
            if shared < len(label):  # split the edge
                upper = [label[:shared], {label[shared]: child}, None]
                child[0] = label[shared:]
                node[1][rest[0]] = child = upper
                added += 200
            node, rest = child, rest[shared:]
        held = node[2]
        node[2] = (owner, count) if held is None else (min(held[0], owner), held[1] + count)
        if added:
            top = key[0]
            self.weights[top] = self.weights.get(top, 0) + added

    def terminals(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            (label, children, value), before = stack.pop()
            key = before + label
            if value is not None:
                yield key, *value
            stack.extend((child, key) for child in children.values())

    def spill(self) -> Iterator[tuple[bytes, tuple, int]]:
        """Remove the heaviest subtree of the root and return its terminals."""
        top = max(self.weights, key=self.weights.get)
        del self.weights[top]
        yield from self.terminals(self.root[1].pop(top))


def merged(entries: Iterable[tuple[bytes, tuple, int]], budget: int) -> Iterator[tuple[bytes, tuple, int]]:
    """Entries of equal bytes joined, as far as one trie of ``budget`` bytes can see them."""
    trie = PatriciaTrie()
    for key, owner, count in entries:
        trie.insert(key, owner, count)
        while trie.weight > budget:
            yield from trie.spill()
    yield from trie.terminals()


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py() or ""


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for doc, text in _texts(batches):
            plain = text.encode().translate(None, _DELETE)
            yield doc, len(text), len(plain), hashlib.sha256(plain).hexdigest()

    yield from rows_out(rows(), _DIGEST)


def _local_owners(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (
            (text.encode().translate(None, _DELETE), (-len(text), doc is None, doc or 0), 1)
            for doc, text in _texts(batches)
        )
        yield from rows_out(
            (
                (len(key), hashlib.sha256(key).hexdigest(), key, *owner, count)
                for key, owner, count in merged(entries, budget)
            ),
            _OWNER,
        )

    return run


def _merged_owners(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (
            (row["_bytes"], (row["_short"], row["_no_id"], row["_id"]), row["_count"])
            for batch in batches
            for part in range(0, batch.num_rows, 256)
            for row in batch.slice(part, 256).to_pylist()
        )
        yield from rows_out(
            (
                (len(key), hashlib.sha256(key).hexdigest(), None, *owner, count)
                for key, owner, count in merged(entries, budget)
            ),
            _OWNER,
        )

    return run


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``_length``, ``_sha``, ``_keep`` (owner), ``_keep_chars``, ``_size``."""
    found = keyed(docs, doc_id, text).mapInArrow(_local_owners(budget), _DDL)
    met = found.repartition("_length", "_sha").mapInArrow(_merged_owners(budget), _DDL)
    return (
        met.groupBy("_length", "_sha")
        .agg(F.min(F.struct("_short", "_no_id", "_id")).alias("_best"), F.sum("_count").alias("_size"))
        .selectExpr(
            "_length",
            "_sha",
            "if(_best._no_id, null, _best._id) as _keep",
            "-_best._short as _keep_chars",
            "_size",
        )
    )


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows equal in identifier and text are counted together before the join and
    multiplied again after it; the first of them may stay.
    """
    rows = (
        keyed(docs, doc_id, text)
        .mapInArrow(_digests, "_id bigint, _chars bigint, _length bigint, _sha string")
        .groupBy("_id", "_chars", "_length", "_sha")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    joined = rows.join(owners(docs, doc_id, text, budget=budget), ["_length", "_sha"])
    return joined.selectExpr(
        "_id as doc_id",
        "_keep as keep_id",
        "_size as group_size",
        "_id <=> _keep and _chars = _keep_chars as _owner",
        "_sha as text_sha256",
        "explode(sequence(1L, _copies)) as _copy",
    ).selectExpr("doc_id", "keep_id", "group_size", "_owner and _copy = 1 as kept", "text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that own their text, with all their columns."""
    winners = (
        classes(docs, doc_id, text, budget=budget)
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_copies"))
        .where("_kept")
        .selectExpr("doc_id as _own", "text_sha256 as _own_key", "_copies")
    )
    plain = F.translate(F.coalesce(F.col(f"d.{text}").cast("string"), F.lit("")), BLANKS, "")
    return owned_rows(docs, winners, F.sha2(plain, 256), doc_id, text)
