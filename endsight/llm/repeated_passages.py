"""Repeated byte strings across documents, by prefix-free parsing.

Every byte that a ``SPAN``-byte string covers which also starts earlier (smaller identifier, or the same document further
to the front) is removed; matches never cross documents and are judged on the texts as given.

Parsing.  A place is a trigger where the rolling hash of its ``GRAM`` bytes is the least among those up to ``REACH`` bytes
around it, a property of the ``TRIGGER`` bytes about it alone, so equal texts have equal triggers.  Phrases run from trigger to
trigger, and no suffix of a phrase is the beginning of another.  The strings that start in a phrase and hold the trigger at its
end stand together: they see the phrase and what follows, their context.

Dictionary.  Spark gathers contexts by their trigger.  A trigger with one context everywhere needs no further look: the first
of its copies stays, all strings of the others go.  Where a trigger has several contexts (the edges of a shared passage, an
edited copy), the first copy of each goes on to the ordering, with those of its strings that can be shared: contexts of a trigger are
sorted by short hashes of ever longer text before it, and after it, and neighbours show how far any other context agrees.
Strings without a trigger go on too.  Copies inside a block of texts meet
before anything travels and become one range per document, so a group of copies of any size costs a row per document.

Order.  Within a block of texts the suffix array of the dictionary (suffixes of distinct phrases) and that of the parse (what
follows each trigger) are built by refining ranks eight bytes at a time, and combine into the order of the corpus: by phrase
suffix, then by rank of what follows.  Equal strings are neighbours there, which a comparison of all their bytes
confirms.  One row per class leaves the block; classes of different blocks meet by a 128-bit digest, and all but the first string go.

Defined cases: null counts as empty; texts below ``SPAN`` bytes keep everything; a null identifier counts as the largest; rows of one
identifier are ordered by a hash of their text, and of rows equal in both all but one lose everything (where the text has
``SPAN`` bytes); other columns are ignored; an empty table gives an empty result.  Contexts are told apart by 64 bits for the
trigger and 64 bits for the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from endsight.llm.common import keyed, settled

#: Bytes of a repeated string, of a hashed gram, and on either side of a trigger.
SPAN, GRAM, REACH = 100, 8, 16
#: Bytes that decide whether a place is a trigger.
TRIGGER = GRAM + 2 * REACH
#: Bytes by which levels of the text before and after a trigger grow, and their number.
LEVEL, LEVELS = 15, 4
#: Bytes and candidate strings that a task works on together.
BLOCK_BYTES, BLOCK_STRINGS = 2 << 20, 1 << 19
#: Codes in the low byte of a place: strings that go as a whole, and strings without a trigger.
GONE, PLAIN = 254, 255

_ONE, _STEP = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LARGEST = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mixed((np.arange(256, dtype=np.uint64) + _ONE) * _STEP)


class Block:
    """Texts one after the other, with the identifiers and ties of their rows."""

    def __init__(self, docs: list[int], ties: list[int], texts: list[bytes]) -> None:
        self.docs, self.ties = np.array(docs, dtype=np.int64), np.array(ties, dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.size = int(self.ends[-1]) if len(texts) else 0
        self.raw = b"".join(texts) + bytes(SPAN + 64)
        order = np.lexsort((self.ties, self.docs))
        same = np.concatenate([[False], (np.diff(self.docs[order]) == 0) & (np.diff(self.ties[order]) == 0)])
        self.ranks = np.empty(len(texts), dtype=np.int64)
        self.ranks[order] = np.cumsum(~same)  # repeated rows share a rank

    def words(self, kind: str) -> np.ndarray:
        """The eight bytes from every place as one number."""
        return np.ndarray(len(self.raw) - 7, kind, self.raw, 0, (1,))

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def triggers(block: Block) -> np.ndarray:
    """Places where the bytes of a trigger start, inside one text each."""
    n = block.size - GRAM + 1
    if n < 2 * REACH + 1:
        return np.zeros(0, dtype=np.int64)
    hashes = mixed(block.words("<u8")[:n] * _STEP)
    least, width = hashes, 1  # least[i]: of the width values from i
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    middle = hashes[REACH : n - REACH]
    found = np.flatnonzero((middle < least[: len(middle)]) & (middle <= least[REACH + 1 : REACH + 1 + len(middle)]))
    return found[found + TRIGGER <= block.ends[block.owner(found)]]


def contexts(block: Block) -> tuple[np.ndarray, ...]:
    """Strings of a block in groups: (text, first start, number, distance of the trigger or PLAIN, hashes of trigger, context, sides).

    ``sides`` has a byte for each level of the text before the trigger, then of that after it, the shortest first.
    Groups without a trigger have hashes of no meaning.
    """
    at = triggers(block)
    text = block.owner(at)
    last_start = block.ends - SPAN
    opens = np.concatenate([[True], np.diff(text) != 0]) if len(at) else np.zeros(0, bool)
    before = np.where(opens, block.begins[text], np.concatenate([[0], at[:-1]]) + 1) if len(at) else at
    first = np.maximum(before, at + TRIGGER - SPAN)
    final = np.minimum(at, last_start[text])
    # starts that see no trigger: too far before one, or after the last
    gap_text = np.concatenate([text, np.arange(len(block.ends))])
    tail = block.begins.copy()
    tail[text] = at + 1  # the last one stays
    gap_first = np.concatenate([before, tail])
    gap_final = np.concatenate([np.minimum(first - 1, last_start[text]), last_start])
    some = gap_first <= gap_final
    gap_text, gap_first, gap_final = gap_text[some], gap_first[some], gap_final[some]
    some = first <= final
    at, text, first, final = at[some], text[some], first[some], final[some]

    words = block.words("<u8")
    trigger = np.zeros(len(at), dtype=np.uint64)
    for k in range(0, TRIGGER, 8):
        trigger = mixed(trigger * np.uint64(3) + words[at + k] + _ONE)
    powers = np.full(block.size + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(block.size + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    data = np.frombuffer(block.raw, dtype=np.uint8, count=block.size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[:-1], dtype=np.uint64)])
    shape = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (final - first).astype(np.uint64)
    context = mixed((sums[final + SPAN] - sums[first]) * back[first] + mixed(shape * _STEP))
    sides = np.zeros(len(at), dtype=np.uint64)
    for before in (True, False):
        for level in range(1, LEVELS + 1):
            low, high = (at - LEVEL * level, at) if before else (at, at + TRIGGER + LEVEL * level)
            inside = (low >= block.begins[text]) & (high <= block.ends[text])
            low, high = np.where(inside, low, 0), np.where(inside, high, 0)
            sides = (sides << np.uint64(8)) | (mixed((sums[high] - sums[low]) * back[low]) >> np.uint64(56))
    return (
        np.concatenate([text, gap_text]),
        np.concatenate([first, gap_first]),
        np.concatenate([final - first + 1, gap_final - gap_first + 1]),
        np.concatenate([at - first, np.full(len(gap_text), PLAIN)]),
        np.concatenate([trigger, mixed(gap_first.astype(np.uint64) * _STEP)]),
        np.concatenate([context, np.zeros(len(gap_text), np.uint64)]),
        np.concatenate([sides, np.zeros(len(gap_text), np.uint64)]),
    )


_CONTEXT = pa.schema([(c, pa.int64()) for c in ("_trigger", "_context", "_sides", "_doc", "_tie", "_at", "_size")])
_CONTEXT_DDL = ", ".join(f"{c} bigint" for c in _CONTEXT.names)


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the columns _doc, _tie, _text of ``batches``."""
    docs, ties, texts, weight = [], [], [], 0
    for batch in batches:
        columns = [batch.column(c) for c in range(3)]
        for i in range(batch.num_rows):
            texts.append(columns[2][i].as_py().encode())
            docs.append(columns[0][i].as_py())
            ties.append(columns[1][i].as_py())
            weight += len(texts[-1])
            if weight >= BLOCK_BYTES:
                yield Block(docs, ties, texts)
                docs, ties, texts, weight = [], [], [], 0
    if texts:
        yield Block(docs, ties, texts)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        text, first, size, distance, trigger, context, sides = contexts(block)
        place = first - block.begins[text]
        rank = block.ranks[text]
        order = np.lexsort((place, rank, context, trigger))
        t, c, r, p = trigger[order], context[order], rank[order], place[order]
        plain = distance[order] == PLAIN
        opens = np.concatenate([[True], (np.diff(t) != 0) | (np.diff(c) != 0)])[: len(order)] | plain
        head = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(order) else order
        itself = (r == r[head]) & (p == p[head])
        fresh = itself & (opens | (np.arange(len(order)) == head))
        stays, goes = order[fresh], order[~itself]
        # what goes as a whole: neighbouring groups of a text become one range
        goes = goes[np.lexsort((place[goes], text[goes]))]
        starts = np.ones(len(goes), dtype=bool)
        starts[1:] = (np.diff(text[goes]) != 0) | (place[goes][1:] != (place[goes] + size[goes])[:-1])
        lead = np.flatnonzero(starts)
        whole = np.add.reduceat(size[goes], lead) if len(goes) else size[goes]
        lead = goes[lead]
        rows = np.concatenate([stays, lead])
        kind = np.concatenate([distance[stays], np.full(len(lead), GONE)])
        alone = mixed((rows.astype(np.uint64) + _ONE) * _STEP ^ trigger[rows])  # needs no company
        special = kind >= GONE
        columns = [
            np.where(special, alone, trigger[rows]).view(np.int64),
            context[rows].view(np.int64),
            np.where(special, 0, sides[rows]).view(np.int64),
            block.docs[text[rows]],
            block.ties[text[rows]],
            (place[rows] << 8) | kind,
            np.concatenate([size[stays], whole]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_CONTEXT)


def refined(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rank of each byte string (start, size) in their order; equal strings share a rank.

    ``words`` has the eight bytes from every place as a number whose order is that of the bytes.
    """
    rank = np.zeros(len(start), dtype=np.int64)
    active, depth = np.arange(len(start)), 0
    while len(active):
        left = np.clip(size[active] - depth, 0, 8).astype(np.uint64)
        word = words[np.where(left > 0, start[active] + depth, 0)].astype(np.uint64)
        shift = (np.uint64(8) - left) * np.uint64(8)
        word = np.where(left > 0, (word >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0))
        order = np.lexsort((word, rank[active]))
        r, w = rank[active][order], word[order]
        new_rank = np.concatenate([[True], np.diff(r) != 0])
        new = new_rank | np.concatenate([[True], w[1:] != w[:-1]])
        at = np.arange(len(r))
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[active[order]] = r + head - np.maximum.accumulate(np.where(new_rank, at, 0))
        alone = new & np.append(new[1:], True)
        active = active[order][~alone]
        depth += 8
        active = active[size[active] > depth]
    return rank


def ordered(block: Block, start: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings at ``start`` in the order of the corpus, and where a class of equal ones begins in it.

    ``distance`` is that from the start to the string's first trigger, or PLAIN.
    """
    words = block.words(">u8")
    plain = distance == PLAIN
    suffix = np.where(plain, SPAN, distance + TRIGGER)
    # dictionary: suffixes of distinct phrases; equal beginnings, ends and lengths are ranked once
    ends = np.stack([words[start].astype(np.uint64), words[start + suffix - 8].astype(np.uint64), suffix.astype(np.uint64)])
    key = mixed(mixed(mixed(ends[0]) + ends[1]) + ends[2])
    middle = mixed(mixed(words[start + 8].astype(np.uint64)) + words[start + suffix // 2].astype(np.uint64))
    _, some, which = np.unique(mixed(key + middle), return_index=True, return_inverse=True)
    exact = np.ones(len(start), dtype=bool)
    for k in range(0, SPAN - 7, 8):  # only true copies may share a rank
        inside = np.flatnonzero(suffix >= k + 8)
        exact[inside] &= words[start[inside] + k] == words[start[some[which[inside]]] + k]
    own = np.concatenate([some, np.flatnonzero(~exact)])
    place = np.empty(len(start), dtype=np.int64)
    place[exact] = which[exact]
    place[~exact] = len(some) + np.arange(len(own) - len(some))
    alpha = refined(words, start[own], suffix[own])[place]
    # parse: what follows each trigger
    marks, mark = np.unique(np.where(plain, 0, start + distance), return_inverse=True)
    follow = refined(words, marks, np.minimum(SPAN, block.ends[np.minimum(block.owner(marks), len(block.ends) - 1)] - marks))
    order = np.lexsort((np.where(plain, 0, follow[mark]), alpha))
    opens = np.ones(len(order), dtype=bool)
    same = np.arange(1, len(order))
    for k in [*range(0, SPAN - 8, 8), SPAN - 8]:
        a, b = start[order[same - 1]] + k, start[order[same]] + k
        same = same[words[a] == words[b]]
    opens[same] = False
    return order, opens


_PLACE = pa.struct([("doc", pa.int64()), ("tie", pa.int64()), ("at", pa.int64())])
_CLASS = pa.schema(
    [*[(c, pa.int64()) for c in ("_high", "_low", "_doc", "_tie", "_at")], ("_others", pa.list_(_PLACE))]
)
_CLASS_DDL = "_high bigint, _low bigint, _doc bigint, _tie bigint, _at bigint, _others array<struct<doc:bigint,tie:bigint,at:bigint>>"


def _classes(block: Block, groups: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Classes of the strings of ``groups`` (text, start in the text, number, distance)."""
    text, first, size, distance = np.array(groups, dtype=np.int64).T
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text, distance = np.repeat(text, size), np.repeat(distance, size)
    start = np.repeat(first, size) + inner + block.begins[text]
    distance = np.where(distance == PLAIN, PLAIN, distance - inner)
    order, opens = ordered(block, start, distance)
    # inside a class by place: the first one stands for the others
    number = np.cumsum(opens) - 1
    place = start - block.begins[text]
    order = order[np.lexsort((place[order], block.ranks[text[order]], number))]
    heads = np.flatnonzero(opens)
    lead = order[heads]
    words = block.words("<u8")
    digests = []
    for seed in (1, 2):
        value = np.full(len(lead), seed, dtype=np.uint64)
        for k in [*range(0, SPAN - 8, 8), SPAN - 8]:
            value = mixed(value * np.uint64(3) + words[start[lead] + k] + _ONE)
        digests.append(value.view(np.int64))
    head = heads[number]
    other = (block.ranks[text[order]] != block.ranks[text[order[head]]]) | (place[order] != place[order[head]])
    rest = order[other]
    counts = np.bincount(number[other], minlength=len(heads))
    members = pa.StructArray.from_arrays(
        [pa.array(block.docs[text[rest]]), pa.array(block.ties[text[rest]]), pa.array(place[rest])], fields=list(_PLACE)
    )
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), members)
    columns = [*digests, block.docs[text[lead]], block.ties[text[lead]], place[lead]]
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], lists], schema=_CLASS)


def _ordered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of the strings that need ordering, of rows (_doc, _tie, _packed, _open)."""
    docs, ties, texts, groups = [], [], [], []
    weight = strings = 0

    def out() -> Iterator[pa.RecordBatch]:
        if groups:
            found = _classes(Block(docs, ties, texts), groups)
            for i in range(0, found.num_rows, 1 << 16):
                yield found.slice(i, 1 << 16)

    for batch in batches:
        columns = [batch.column(c) for c in range(4)]
        for i in range(batch.num_rows):
            for group in columns[3][i].as_py():
                groups.append((len(texts), group["at"] >> 8, group["size"], group["at"] & 255))
                strings += group["size"]
            docs.append(columns[0][i].as_py())
            ties.append(columns[1][i].as_py())
            texts.append(zlib.decompress(columns[2][i].as_py()))
            weight += len(texts[-1])
            if weight >= BLOCK_BYTES or strings >= BLOCK_STRINGS:
                yield from out()
                docs, ties, texts, groups, weight, strings = [], [], [], [], 0, 0
    yield from out()


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_KEPT = pa.schema(
    [("_id", pa.int64()), ("_n_bytes", pa.int64()), ("_n_removed", pa.int64()), ("_spans", pa.list_(_SPAN)), ("_kept", pa.binary())]
)
_KEPT_DDL = "_id bigint, _n_bytes bigint, _n_removed bigint, _spans array<struct<start:bigint,end:bigint>>, _kept binary"


def cut(data: bytes, first: np.ndarray, size: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal spans covered by the strings that start at first .. first + size - 1, and what is left of ``data``."""
    if not len(first):
        return [], data
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((first + size - 1 + SPAN)[order])
    opens = np.concatenate([[True], begin[1:] > end[:-1]])
    heads = np.flatnonzero(opens)
    spans = list(zip(begin[heads].tolist(), end[np.append(heads[1:], len(end)) - 1].tolist(), strict=True))
    keep = [0, *[x for s in spans for x in s], len(data)]
    return spans, b"".join(data[a:b] for a, b in zip(keep[::2], keep[1::2], strict=True))


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (_id, _packed, _copy, _ranges, _starts)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part, rows = batch.slice(start, 256), []
            for doc, packed, copy, ranges, starts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = zlib.decompress(packed)
                if copy > 1:
                    first, size = np.zeros(1, np.int64), np.array([len(data) - SPAN + 1])
                else:
                    starts = np.array(starts or [], dtype=np.int64)
                    first = np.concatenate([np.array([x["at"] >> 8 for x in ranges or []], dtype=np.int64), starts])
                    size = np.concatenate([np.array([x["size"] for x in ranges or []], dtype=np.int64), np.ones(len(starts), np.int64)])
                spans, kept = cut(data, first, size)
                rows.append((doc, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KEPT.types, strict=True)], schema=_KEPT)


@F.arrow_udf(BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts as they travel."""
    return pa.array((zlib.compress(t.as_py().encode(), 1) for t in texts), pa.binary())


def _agrees(column: str, order: str) -> str:
    """Levels in which ``column`` (a byte a level) agrees with a neighbour in ``order``, -1 without one."""
    levels = []
    for other in ("lag", "lead"):
        value = f"{other}({column}) over ({order})"
        steps = " ".join(f"when shiftright({column}, {8 * (LEVELS - 1 - k)}) <> shiftright({value}, {8 * (LEVELS - 1 - k)}) then {k}" for k in range(LEVELS))
        levels.append(f"case when {value} is null then -1 {steps} else {LEVELS} end")
    return f"greatest({', '.join(levels)})"


def open_groups(rows: DataFrame) -> DataFrame:
    """Per document of ``rows`` (_doc, _tie, _text) the groups of strings that go and those that need ordering: ``_groups``."""
    parsed = rows.mapInArrow(_parsed, _CONTEXT_DDL).repartition("_trigger")
    own = "partition by _trigger, _context order by _doc, _tie, _at"
    judged = parsed.selectExpr(
        "*",
        "_at & 255 as _kind",
        f"first(struct(_doc, _tie, _at)) over ({own}) <> struct(_doc, _tie, _at) as _again",
        "min(_context) over (partition by _trigger) <> max(_context) over (partition by _trigger) as _several",
    )
    # copies are set apart, so that neighbours are other contexts
    marked = judged.where(f"_kind >= {GONE} or _again or _several").selectExpr(
        "_trigger",
        "_doc",
        "_tie",
        "_at",
        "_size",
        "_kind",
        f"_kind = {GONE} or (_kind < {GONE} and _again) as _goes",
        "shiftright(_sides, 32) & 4294967295L as _left",
        "_sides & 4294967295L as _right",
    )
    levelled = marked.selectExpr(
        "*",
        f"{_agrees('_left', 'partition by _trigger, _goes order by _left')} as _before",
        f"{_agrees('_right', 'partition by _trigger, _goes order by _right')} as _after",
    )
    # a string at distance d needs d bytes before the trigger and SPAN - d after it
    far = f"if(_before < {LEVELS}, least(_kind, {LEVEL} * (_before + 1) - 1), _kind)"
    near = f"greatest(_kind - _size + 1, {SPAN - TRIGGER - LEVEL + 1} - {LEVEL} * _after)"
    ranged = levelled.selectExpr("*", f"{far} as _far", f"{near} as _near").selectExpr(
        "_doc",
        "_tie",
        f"""case when _goes then struct((_at & ~255L) | {GONE} as at, _size as size)
          when _kind = {PLAIN} then struct(_at as at, _size as size)
          when _far >= _near then struct(shiftleft(shiftright(_at, 8) + _kind - _far, 8) | _far as at, _far - _near + 1 as size) end as _group""",
    )
    return ranged.where("_group is not null").groupBy("_doc", "_tie").agg(F.collect_set("_group").alias("_groups"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``_id, _n_bytes, _n_removed, _spans`` (start, end in bytes) and ``_kept`` (bytes)."""
    rows = keyed(docs, doc_id, text).withColumns(
        {"_text": F.coalesce("_text", F.lit("")), "_doc": F.coalesce("_id", F.lit(_LARGEST))}
    )
    # what orders rows of one identifier travels only where identifiers repeat
    shared = not rows.groupBy("_doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("_tie", F.expr("xxhash64(_text)" if shared else "0L"))
    short = rows.where(f"octet_length(_text) < {SPAN}").selectExpr(
        "_id",
        "bigint(octet_length(_text)) as _n_bytes",
        "0L as _n_removed",
        "cast(array() as array<struct<start:bigint,end:bigint>>) as _spans",
        "encode(_text, 'UTF-8') as _kept",
    )
    long = rows.where(f"octet_length(_text) >= {SPAN}")
    groups = settled(open_groups(long.select("_doc", "_tie", "_text")))
    travelling = long.select("_id", "_doc", "_tie", packed("_text").alias("_packed"))

    some = groups.selectExpr("_doc", "_tie", f"filter(_groups, g -> (g.at & 255) <> {GONE}) as _open").where("size(_open) > 0")
    opened = travelling.join(some, ["_doc", "_tie"]).select("_doc", "_tie", "_packed", "_open")
    classes = opened.mapInArrow(_ordered, _CLASS_DDL).repartition("_high", "_low")
    same = "partition by _high, _low order by _doc, _tie, _at"
    here = "named_struct('doc', _doc, 'tie', _tie, 'at', _at)"
    repeats = classes.selectExpr(
        "_others", f"{here} as _here", f"first({here}) over ({same}) <> {here} as _again"
    ).selectExpr("inline(if(_again, concat(_others, array(_here)), _others))")
    starts = settled(
        repeats.groupBy("doc", "tie").agg(F.collect_set("at").alias("_starts")).selectExpr("doc as _doc", "tie as _tie", "_starts")
    )

    gone = groups.selectExpr("_doc", "_tie", f"filter(_groups, g -> (g.at & 255) = {GONE}) as _ranges")
    removals = gone.join(starts, ["_doc", "_tie"], "full")
    finished = (
        travelling.join(removals, ["_doc", "_tie"], "left")
        .selectExpr(
            "_id", "_packed", "row_number() over (partition by _doc, _tie order by _doc) as _copy", "_ranges", "_starts"
        )
        .mapInArrow(_finished, _KEPT_DDL)
    )
    return finished.unionByName(short)
