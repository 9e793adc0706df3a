"""Periodic runs of words, found in a grammar instead of in the text.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(``LEAST_LENGTH``, ``LEAST_POWER`` * q) that no neighbouring word extends.

Re-Pair.  Each round counts the pairs of neighbouring symbols and gives every repeated pair that outranks
the pairs it overlaps (more frequent first) a new symbol, at all its places at once, until no pair of a text
repeats.  Symbols belong to one text, so the texts of a batch are worked on side by side.

Boundaries.  A run lies within a smallest symbol, whose two halves it touches, or touches a boundary of the sequence that
is left.  Of a run of four periods or more two periods lie on one side of that boundary, so it begins or ends
with a square there: candidates are the places where the four words at the boundary occur again (periods below four
are compared directly).  Each symbol's boundary is examined once, at the symbol's first place.

Translation.  Each run of a symbol is carried to all places where the symbol was made and extended there as far as the text
keeps the period; intervals that become equal are one run, with the smallest period.

Texts are the unit of work: Spark deals the rows to tasks, and a task holds one batch.

Defined cases: a null text has no words and no runs; an empty text too; repeated rows give repeated results; a null identifier
counts as empty text where words are derived from it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from endsight.llm.common import keyed, rows_out

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Words at a boundary that must occur again for a period of at least as many words.
GRAM = 4
#: Words worked on together, and candidate places expanded together.
BLOCK_WORDS, BLOCK_PLACES = 300_000, 1 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema(
    [("_id", pa.int64()), ("_n_words", pa.int64()), ("_runs", pa.list_(_RUN)), ("_best", _RUN), ("_kept", pa.string())]
)
_STRUCT = "struct<start:bigint,length:bigint,period:bigint>"
_DDL = f"_id bigint, _n_words bigint, _runs array<{_STRUCT}>, _best {_STRUCT}, _kept string"

Words = list[bytes]


def planted(doc_id: int | None, words: Words) -> Words:
    """The contract's test texts: one text in ten repeats a stretch of itself to its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    unit = words[first : first + period]
    return words[:first] + (unit * (-(-(n - first) // period)))[: n - first]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def re_pair(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of ``words``: the places of the symbols left, and (symbol, start, middle, end) of every symbol made.

    Returns (places of the sequence left, symbols of the nodes, their three places as rows).
    """
    symbols, places = words.astype(np.int64), np.arange(len(words) + 1)
    fresh_id = int(symbols.max(initial=0)) + 1
    active = np.ones(max(len(symbols) - 1, 0), dtype=bool)
    made, spans = [], []
    while True:
        at = np.flatnonzero(active)
        pair = (symbols[at] << 31) | symbols[at + 1]
        _, group, count = np.unique(pair, return_inverse=True, return_counts=True)
        repeated = count[group] > 1
        at, group = at[repeated], group[repeated]
        if not len(at):
            break
        # rank of a pair: its count, then its number; distinct pairs never tie
        rank = np.zeros(len(symbols) + 1, dtype=np.int64)
        rank[at + 1] = count[group] * len(count) + group  # shifted by one, so that 0 lies before the first
        own = rank[at + 1]
        opens = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own) != 0)])
        chain = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(at)) - 1
        wins = (rank[at[first]] < own[first]) & (rank[np.minimum(at[last] + 2, len(symbols))] < own[first])
        chosen = wins[chain] & ((np.arange(len(at)) - first[chain]) % 2 == 0)
        left, group = at[chosen], group[chosen]
        numbers, code = np.unique(group, return_inverse=True)
        made.append(code + fresh_id)
        spans.append(np.stack([places[left], places[left + 1], places[left + 2]]))
        symbols[left] = code + fresh_id
        fresh_id += len(numbers)
        still, fresh, keep = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool), np.ones(len(symbols), bool)
        still[at], fresh[left], keep[left + 1] = True, True, False
        symbols, places = symbols[keep], places[np.append(keep, True)]
        fresh, still = fresh[keep], still[keep]
        active = fresh[:-1] | fresh[1:] | still[:-1]
    nodes = np.concatenate(made) if made else np.zeros(0, dtype=np.int64)
    return places, nodes, np.concatenate(spans, axis=1) if spans else np.zeros((3, 0), dtype=np.int64)


class Sequence:
    """Words of several texts, each followed by a mark of its own, with hashes of all prefixes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        n = len(words)
        factor = np.full(n + 1, 0xD1342543DE82EF95, dtype=np.uint64)
        factor[0] = 1
        self.powers = np.multiply.accumulate(factor)
        values = scrambled(words.astype(np.uint64)) * self.powers[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from a and from b (a <= b) are the same."""
        return (self.sums[a + size] - self.sums[a]) * self.powers[b - a] == self.sums[b + size] - self.sums[b]

    def common(self, a: np.ndarray, b: np.ndarray, backwards: bool) -> np.ndarray:
        """Number of equal words after (or before) the places a < b."""
        n = len(self.words)
        size = np.zeros(len(a), dtype=np.int64)
        step = 1 << max(n.bit_length() - 1, 0)
        while step:
            if backwards:
                fits = a - size - step >= 0
                low = np.where(fits, a - size - step, 0)
            else:
                fits = b + size + step <= n
                low = np.where(fits, a + size, 0)
            high = np.where(fits, low + b - a, 0)
            size += step * (fits & self.equal(low, high, np.where(fits, step, 0)))
            step >>= 1
        return size

    def stretch(self, a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest stretch around the square at ``a`` that keeps period q."""
        return a - self.common(a, a + q, True), a + q + self.common(a, a + q, False)


def squares(text: Sequence, middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squares that begin or end at ``middle`` within [low, high): number of the boundary, start, period."""
    x, n = text.words, len(text.words)
    found = []
    for q in range(1, GRAM):
        for start in (middle, middle - 2 * q):
            fits = np.flatnonzero((start >= low) & (start + 2 * q <= high))
            a = start[fits]
            same = np.ones(len(a), dtype=bool)
            for j in range(q):
                same &= x[a + j] == x[a + q + j]
            found.append((fits[same], a[same], np.full(int(same.sum()), q)))
    if n >= 2 * GRAM:
        gram = np.zeros(n - GRAM + 1, dtype=np.uint64)
        for j in range(GRAM):
            gram = scrambled(gram + x[j : n - GRAM + 1 + j].astype(np.uint64))
        _, group, count = np.unique(gram, return_inverse=True, return_counts=True)
        several = count[group] > 1
        sorted_places = np.flatnonzero(several)
        by_group = np.sort(group[sorted_places] * np.int64(n + 1) + sorted_places)
        for right in (True, False):
            anchor = middle if right else middle - GRAM
            reach = np.where(right, high - middle, middle - low) // 2
            ok = np.flatnonzero((reach >= GRAM) & (anchor >= 0) & (anchor < len(gram)))
            ok = ok[several[anchor[ok]]]
            base = group[anchor[ok]] * np.int64(n + 1) + anchor[ok]
            if right:
                begin, end = np.searchsorted(by_group, base + GRAM), np.searchsorted(by_group, base + reach[ok], "right")
            else:
                begin, end = np.searchsorted(by_group, base - reach[ok]), np.searchsorted(by_group, base - GRAM, "right")
            # a neighbouring group's entries differ by more than a text's length or are cut off here
            begin = np.maximum(begin, np.searchsorted(by_group, base - anchor[ok]))
            end = np.minimum(end, np.searchsorted(by_group, base - anchor[ok] + n, "right"))
            sizes = np.maximum(end - begin, 0)
            ends = np.cumsum(sizes)
            cuts = [0, *np.searchsorted(ends, np.arange(BLOCK_PLACES, int(ends[-1]) if len(ends) else 0, BLOCK_PLACES)).tolist(), len(ok)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = sizes[i:j]
                who = np.repeat(np.arange(i, j), part)
                inner = np.arange(len(who)) - np.repeat(np.cumsum(part) - part, part)
                place = by_group[begin[who] + inner] % (n + 1)
                q = np.abs(place - anchor[ok[who]])
                a = middle[ok[who]] - (0 if right else 2 * q)
                same = text.equal(a, a + q, q)
                found.append((ok[who[same]], a[same], q[same]))
    boundary, start, period = (np.concatenate(c) for c in zip(*found, strict=True))
    return boundary.astype(np.int64), start.astype(np.int64), period.astype(np.int64)


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period; words are small numbers from 0."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    joined = np.empty(total, dtype=np.int64)
    fresh = len(texts)  # the numbers below are the marks
    for i, t in enumerate(texts):
        joined[offsets[i] : offsets[i] + len(t)] = t + fresh
        joined[offsets[i] + len(t)] = i
        fresh += int(t.max(initial=-1)) + 1
    places, nodes, spans = re_pair(joined)
    text = Sequence(joined)

    # boundaries: those of the sequence left, inside a text, and one of each symbol
    inner = places[1:-1]
    inner = inner[(joined[inner] >= len(texts)) & (joined[inner - 1] >= len(texts))]
    owner = np.searchsorted(offsets, inner, "right") - 1
    order = np.argsort(nodes, kind="stable")
    by_symbol = nodes[order]
    symbols, first = np.unique(by_symbol, return_index=True)
    primary = spans[:, order[first]]
    middle = np.concatenate([inner, primary[1]])
    low = np.concatenate([offsets[owner], primary[0]])
    high = np.concatenate([offsets[owner] + sizes[owner], primary[2]])
    boundary, a, q = squares(text, middle, low, high)
    start, end = text.stretch(a, q)
    inside = np.minimum(end, high[boundary]) - np.maximum(start, low[boundary]) >= np.maximum(LEAST_LENGTH, LEAST_POWER * q)
    boundary, a, q = boundary[inside], a[inside], q[inside]

    # translate those of symbols to all places of the symbol
    top = boundary < len(inner)
    number = boundary[~top] - len(inner)
    begin, stop = np.searchsorted(by_symbol, symbols[number]), np.searchsorted(by_symbol, symbols[number], "right")
    copies = stop - begin
    who = np.repeat(np.arange(len(number)), copies)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(copies) - copies, copies)
    moved = spans[0, order[begin[who] + nth]] - primary[0, number[who]]
    all_a = np.concatenate([a[top], a[~top][who] + moved])
    all_q = np.concatenate([q[top], q[~top][who]])
    start, end = text.stretch(all_a, all_q)

    results: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    previous = None
    for s, e, period in np.unique(np.stack([start, end, all_q], axis=1), axis=0).tolist():
        if (s, e) != previous:  # of equal intervals the smallest period comes first
            i = int(np.searchsorted(offsets, s, "right")) - 1
            results[i].append((s - int(offsets[i]), e - s, period))
        previous = (s, e)
    for found in results:
        found.sort(key=lambda r: (r[0], r[2]))
    return results


def numbered_words(words: Words) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)


def _rows(held: list[tuple[int | None, Words]]) -> Iterator[tuple]:
    for (doc, words), runs in zip(held, runs_of([numbered_words(w) for _, w in held]), strict=True):
        best, kept = None, words
        if runs:
            start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            best = {"start": start, "length": length, "period": period}
            stays = np.ones(len(words), dtype=bool)
            for start, length, period in runs:
                stays[start + period : start + length] = False
            kept = [words[i] for i in np.flatnonzero(stays).tolist()]
        listed = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        yield doc, len(words), listed, best, b" ".join(kept).decode()


def _found(derive: Callable[[int | None, Words], Words] | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: list[tuple[int | None, Words]] = []
            weight = 0
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    doc = ids[i].as_py()
                    words = (texts[i].as_py() or "").encode().split()  # of bytes: at the contract's blanks
                    if derive:
                        words = derive(doc, words)
                    held.append((doc, words))
                    weight += len(words) + 1
                    if weight >= BLOCK_WORDS:
                        yield from _rows(held)
                        held, weight = [], 0
            if held:
                yield from _rows(held)

        yield from rows_out(rows(), _SCHEMA)

    return run


def find(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    derive: Callable[[int | None, Words], Words] | None = None,
) -> DataFrame:
    """One row per document: ``_id, _n_words, _runs, _best, _kept``.

    ``_runs`` has all runs by start and period, ``_best`` the one with the greatest exact
    length / period (ties: smallest start, then period), ``_kept`` the words that no run holds after its
    first period, joined by blanks.  ``derive`` may replace the words of a text first.
    """
    return keyed(docs, doc_id, text).mapInArrow(_found(derive), _DDL)
