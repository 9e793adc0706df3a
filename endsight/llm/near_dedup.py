"""Near-duplicate detection by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number,
so that all labelled shingles of a text differ (a text of fewer words is one shingle).  Two
texts a and b are linked if L / (|a| + |b| - L) >= 0.8, where L is the length of their longest common
subsequence of labelled shingles: the Jaccard similarity of what both hold in the same
order.

Candidates.  A sketch takes the l labelled shingles with the smallest hashes and keeps them
in text order; two texts of similarity J agree in one sketch with a chance of about J ** l.  Numbers
of sketches and l depend on the length (``CLASSES``; lengths of linked texts differ by at
most a quarter, and the ranges overlap by that much), such that texts at J = 0.8
agree in 12 sketches or more on average, and texts that merely share a passage in almost none.  The texts of one
sketch value are joined to the first of them, never with each other; a text and a first
that meet in two sketches or more belong to one cluster.  A pair at exactly 0.8 is missed
with a chance of about 1 in 10,000, more similar pairs far more rarely.

Verification.  Clusters are cut into blocks of bounded size; each pair of blocks is a group of
its own.  Within it, common shingles of all pairs are counted by matrix products, and pairs that
could reach 0.8 and are not yet connected are aligned: only matches within the band that 0.8
allows count, and as labelled shingles are unique the alignment is a longest increasing run of places.
Only links that connect leave a group.  Connected texts form a class.

Exact copies (equal words) meet as one text before any of this, so groups of copies of any size cost
one sketch per task.  Clusters are split by rows and by bytes, so no group outgrows a task;
nothing is capped or sampled.

Defined cases: null and blank texts are copies of each other and form a class; a class's id is its
smallest identifier (null if it has no other); of rows equal in identifier and words one stays; other
columns are carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import owned_rows, small_batches
from endsight.operators.scale import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: Least and most shingles, minima kept per sketch, sketches.
CLASSES = ((1, 30, 3, 32), (24, 100, 6, 48), (80, None, 7, 64))
#: Sketches in which a text and the first of a value must meet.
MEETINGS = 2
#: Texts and bytes of words per block of a cluster.
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_WORDS = "regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a text, from its word hashes; equal shingles get different labels."""
    words = words.view(np.uint64)
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = mixed(total + words[k : k + n])
    order = np.argsort(total, kind="stable")
    ordered = total[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if fresh.all():
        return total
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    occurrence = np.zeros(n, dtype=np.uint64)
    occurrence[order] = (np.arange(n) - start).astype(np.uint64)
    return np.where(occurrence > 0, mixed(total + occurrence * _STEP), total)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One value per sketch of each length class that the text belongs to."""
    n, found = len(shingles), []
    for c, (least, most, kept, count) in enumerate(CLASSES):
        if n < least or (most is not None and n > most):
            continue
        seeds = mixed((np.arange(count, dtype=np.uint64) + np.uint64(1 + 1000 * c)) * _STEP)
        rows = max(1, (1 << 19) // n)
        for start in range(0, count, rows):
            own = seeds[start : start + rows, None]
            places = np.broadcast_to(np.arange(n), (len(own), n))
            if n > kept:
                hashes = (shingles[None, :] ^ own) * (own | np.uint64(1))
                places = np.sort(np.argpartition(hashes, kept - 1, axis=1)[:, :kept], axis=1)
            value = own[:, 0].copy()
            for k in range(places.shape[1]):  # in text order
                value = mixed(value * np.uint64(3) + shingles[places[:, k]])
            found.append(value)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two labelled sequences along the band that ``similarity`` allows, else 0."""
    total = len(a) + len(b)
    # L >= s / (1 + s) * total, so at most total - 2 L shingles stand outside the alignment
    band = int(total * (1 - similarity) / (1 + similarity)) + 1
    _, left, right = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(left - right) <= band
    order = np.argsort(left[near])
    places = right[near][order]
    if len(places) > 1 and not (np.diff(places) > 0).all():
        tails: list[int] = []
        from bisect import bisect_left

        for p in places.tolist():
            at = bisect_left(tails, p)
            tails[at : at + 1] = [p]
        common = len(tails)
    else:
        common = len(places)
    value = common / (total - common) if total > common else 1.0
    return value if value >= similarity else 0.0


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common labelled shingles of all pairs, by products of 0/1 matrices over column chunks."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), dtype=np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        total += part @ part.T
    return total


def connecting_links(sets: list[np.ndarray], across: list[bool] | None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Verified pairs that connect: a spanning forest of the linked pairs.

    With ``across`` only pairs of a True and a False text are looked at.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    common = overlaps(sets)
    likeness = common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1)
    upper = np.triu(likeness >= similarity - 1e-6, 1)
    if across is not None:
        side = np.array(across)
        upper &= side[:, None] != side[None, :]
    left, right = np.nonzero(upper)
    order = np.lexsort((right, left, -likeness[left, right]))
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b and aligned(sets[i], sets[j], similarity):
            parent[a] = b
            links.append((i, j))
    return links


def _lists(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    lists = batch.column(column)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in lists)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values[a:b]


_BANDS = pa.schema([("_node", pa.int64()), ("_band", pa.int64())])


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            nodes, bands = [], []
            for node, words in zip(part.column(0).to_pylist(), _lists(part, 1), strict=True):
                if node in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                found = sketches(labelled_shingles(words)).view(np.int64)
                nodes.append(np.full(len(found), node, dtype=np.int64))
                bands.append(found)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(bands))], schema=_BANDS
                )


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows (_cluster, _i, _j, _block, _key, _hashes) that follow one another."""
    group, keys, sets, blocks = None, [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        across = [b == group[1] for b in blocks] if group and group[1] != group[2] else None
        links = connecting_links(sets, across)
        if links:
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i, _ in links], pa.binary()), pa.array([keys[j] for _, j in links], pa.binary())],
                schema=_LINKS,
            )

    for batch in batches:
        heads = zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)
        for (cluster, i, j, block, key), words in zip(heads, _lists(batch, 5), strict=True):
            if (cluster, i, j) != group:
                yield from out()
                group, keys, sets, blocks = (cluster, i, j), [], [], []
            if not keys or keys[-1] != key:  # rows are sorted by key within a group
                keys.append(key)
                sets.append(labelled_shingles(words))
                blocks.append(block)
    yield from out()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a that is not the smallest node b of its component.

    Alternates two steps until nothing changes: every node hands its larger neighbours
    to its smallest one, then its smaller neighbours too.  Both are sums per node, and the
    edges are written to the shared folder after each round.
    """
    current = cut_lineage(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a <> b").distinct())
    before = None
    while True:
        both = current.unionByName(current.selectExpr("b as a", "a as b"))
        lowest = both.groupBy("a").agg(F.min("b").alias("_low")).selectExpr("a", "least(a, _low) as _low")
        large = both.join(lowest, "a").where("b > a").selectExpr("b as a", "_low as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_low"))
        small = large.join(least, "a").where("b <> _low").selectExpr("b as a", "_low as b")
        current = cut_lineage(small.unionByName(least.selectExpr("a", "_low as b")).distinct())
        now = tuple(current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            return current
        before = now


def _words(text: str) -> Column:
    return F.expr(_WORDS.format(text=f"coalesce(cast({text} as string), '')"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _words, _key`` (digest of the words) and ``_node``, a short handle of the key."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), _words(f"`{text}`").alias("_words"))
    return rows.withColumn("_key", F.expr("unhex(md5(array_join(_words, ' ')))")).withColumn(
        "_node", F.expr("xxhash64(_key)")
    )


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_node, _cluster`` of texts that meet another in enough sketches."""
    rows = _keyed(docs, doc_id, text).select("_node", F.expr("transform(_words, w -> xxhash64(w))").alias("_hashes"))
    # both uses below read this one exchange; the filter is what the join would add to one of them
    bands = (
        rows.mapInArrow(_sketched, "_node bigint, _band bigint")
        .where("_band is not null and _node is not null")
        .repartition("_band")
    )
    firsts = (
        bands.groupBy("_band")
        .agg(F.min("_node").alias("_first"), F.max("_node").alias("_last"))
        .where("_first <> _last")
        .select("_band", "_first")
    )
    meetings = (
        bands.join(firsts, "_band")
        .where("_node <> _first")
        .groupBy("_node", "_first")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(f"_n >= {MEETINGS}")
    )
    stars = components(meetings.selectExpr("_node as a", "_first as b"))
    return stars.selectExpr("a as _node", "b as _cluster").unionByName(
        stars.selectExpr("b as _node", "b as _cluster").distinct()
    )


def text_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _key, _node, _size`` (words) of every row, written once for the steps that follow."""
    return cut_lineage(
        _keyed(docs, doc_id, text).select("_id", "_key", "_node", F.expr("bigint(size(_words))").alias("_size"))
    )


def links(docs: DataFrame, narrow: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified links (a, b) between keys of different texts, enough to connect each class.

    ``narrow`` is :func:`text_keys` of ``docs``.
    """
    members = clusters(docs, doc_id, text)
    # one row stands for a text; struct keeps a null identifier usable
    texts = narrow.groupBy("_key", "_node").agg(F.min(F.struct("_id")).alias("_one"), F.max("_size").alias("_size"))
    held = cut_lineage(
        texts.join(members, "_node").selectExpr("_key", "_node", "_one._id as _own", "_size", "_cluster")
    )
    blocks = held.groupBy("_cluster").agg(
        F.expr(f"int(greatest(ceil(count(1) / {BLOCK_ROWS}), ceil(sum(_size) * 8 / {BLOCK_BYTES})))").alias("_blocks")
    )
    placed = held.join(blocks, "_cluster").selectExpr(
        "_key as _member", "_node as _handle", "_own", "_cluster", "int(pmod(xxhash64(_key, 1), _blocks)) as _block", "_blocks"
    )
    # identifier and handle together: rows without an identifier do not all meet
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("_node", F.expr(f"xxhash64(unhex(md5(array_join({_WORDS.format(text="coalesce(_text, '')")}, ' '))))"))
    chosen = rows.join(placed, F.expr("_node = _handle and _id <=> _own"))
    # repeated rows meet within each task before their text travels
    once = chosen.groupBy("_member", "_cluster", "_block", "_blocks").agg(F.first("_text").alias("_text"))
    hashed = (
        once.withColumn("_words", _words("_text"))
        .selectExpr("*", "explode(sequence(0, _blocks - 1)) as _other")
        .selectExpr(
            "_cluster",
            "least(_block, _other) as _i",
            "greatest(_block, _other) as _j",
            "_block",
            "_member as _key",
            "transform(_words, w -> xxhash64(w)) as _hashes",
        )
    )
    grouped = hashed.repartition("_cluster", "_i", "_j").sortWithinPartitions("_cluster", "_i", "_j", "_key")
    return grouped.mapInArrow(_verified, "a binary, b binary")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept`` and ``_key``."""
    keys = text_keys(docs, doc_id, text)
    narrow = keys.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_copies"))
    stars = components(links(docs, keys, doc_id, text))
    texts = narrow.groupBy("_key").agg(F.min(F.expr("struct(_id is null as n, _id)")).alias("_one"), F.sum("_copies").alias("_n"))
    labelled = texts.join(stars.selectExpr("a as _a", "b as _b"), F.expr("_key = _a"), "left").selectExpr(
        "_key", "coalesce(_b, _key) as _class", "_one", "_n"
    )
    owners = labelled.groupBy("_class").agg(
        F.min(F.struct("_one", "_key")).alias("_best"), F.sum("_n").alias("_size")
    )
    known = labelled.select("_key", "_class").join(owners, "_class").selectExpr(
        "_key as _k", "_best._one._id as _owner", "_best._key = _key as _own", "_size"
    )
    return (
        narrow.join(known, F.expr("_key = _k"))
        .selectExpr("*", "explode(sequence(1L, _copies)) as _copy")
        .selectExpr(
            "_id as doc_id",
            "_owner as class_id",
            "_size as class_size",
            "_own and _id <=> _owner and _copy = 1 as kept",
            "_key",
        )
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns of ``docs``."""
    winners = (
        classes(docs, doc_id, text)
        .groupBy("doc_id", "_key")
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_copies"))
        .where("_kept")
        .selectExpr("doc_id as _own", "_key as _own_key", "_copies")
    )
    key = F.expr(f"unhex(md5(array_join({_WORDS.format(text=f'coalesce(cast(d.`{text}` as string), {chr(39)}{chr(39)})')}, ' ')))")
    return owned_rows(docs, winners, key, doc_id, text)
