"""Spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words that differ by one inserted, deleted or replaced letter the shorter (of equal ones, both) gives
disjoint chunks, the longer its grams at the same places and one place on.  The word is cut into two chunks; the
edit damages one of them, the other is met again unshifted (when it lies before the edit) or shifted by the difference of the
lengths.  A half of a short word is shared by far too many words, so the damaged half is cut into two chunks in turn, of which one
is met again: a key is the surviving half with the surviving quarter, four for a word as giver of chunks, four for each of
the two lengths as giver of grams.  Words of one key differ in a quarter of their letters at most, so a key gathers few words
that are not near, and no pair is missed.  Every pair of a key is verified by its edit distance.

A word's form is its most frequent near word, where that is ``RATIO`` times as frequent; its root is
the last word that forms lead to.  Frequencies grow tenfold with each step, so doubling the paths reaches all roots in a few joins.

Defined cases: a null text has no words; a null identifier counts as empty text in the hash of the contract; repeated rows
count as often as they occur; ties of frequency go to the smallest word in code-point order; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import keyed, rows_out
from endsight.operators.scale import cut_lineage, skew_join

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Distinct words that a task counts before it sends its sums on.
HELD_WORDS = 200_000

#: Letters of the contract in one byte each; every other byte is a blank.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)
_COUNTS = pa.schema([("_word", pa.string()), ("_n", pa.int64())])

Derive = Callable[[int | None, bytes], bytes]


def dropped_letter(doc_id: int | None, run: bytes) -> bytes:
    """The contract's test misspellings: one (document, run) in 31 loses a letter."""
    head = "" if doc_id is None else doc_id
    h = zlib.crc32(f"{head}:{run.decode('latin-1')}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(derive: Derive | None, letters: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def rows() -> Iterator[tuple[str, int]]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    text = texts[i].as_py()
                    if text is None:
                        continue
                    # a letter outside the range is one byte too, a blank
                    runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split(b" "))
                    runs.pop(b"", None)
                    doc = ids[i].as_py()
                    for word, n in runs.items():
                        if len(word) >= letters:
                            word = derive(doc, word) if derive else word
                            if len(word) >= letters:
                                sums[word] += n
                    if len(sums) >= HELD_WORDS:
                        yield from ((w.decode("latin-1"), n) for w, n in sums.items())
                        sums.clear()
            yield from ((w.decode("latin-1"), n) for w, n in sums.items())

        yield from rows_out(rows(), _COUNTS)

    return run


def words(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    letters: int = LEAST_LETTERS,
    least: int = LEAST_COUNT,
    derive: Derive | None = None,
) -> DataFrame:
    """Distinct words of at least ``letters`` letters with at least ``least`` occurrences: ``word, n``.

    ``derive`` may change a run of a document first; it may shorten a run but not lengthen it.
    """
    counted = keyed(docs, doc_id, text).mapInArrow(_counted(derive, letters), "_word string, _n bigint")
    return counted.groupBy(F.col("_word").alias("word")).agg(F.sum("_n").alias("n")).where(F.col("n") >= least)


def _keys(length: str, shift: str) -> str:
    """One key per quarter that may be damaged: what stands before it, and what stands after it, ``shift`` further on.

    ``length`` is the length of the word that gives the chunks, whichever side the key is built on.
    """
    ends = ["0", f"{length} div 4", f"{length} div 2", f"{length} div 2 + ({length} - {length} div 2) div 2", length]
    made = [
        f"xxhash64({length}, {j}, substr(word, 1, {a}), substr(word, {b} + {shift} + 1, {length} - ({b})))"
        for j, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))
    ]
    return f"array({', '.join(made)})"


def links(vocabulary: DataFrame) -> DataFrame:
    """Pairs of ``vocabulary`` (word, n; words of 4 letters or more) one edit apart, each once: ``a, a_n, b, b_n``.

    ``a`` is the shorter word, or the smaller of two equally long ones.
    """
    sized = vocabulary.selectExpr("word", "n", "length(word) as size")
    chunks = sized.selectExpr("word as a", "n as a_n", f"explode({_keys('size', '0')}) as _key")
    same = sized.selectExpr("word as b", "n as b_n", f"explode({_keys('size', '0')}) as _key")
    longer = sized.where("size > 4").selectExpr("word as b", "n as b_n", f"explode({_keys('(size - 1)', '1')}) as _key")
    grams = same.unionByName(longer)
    near = "(length(a) < length(b) or a < b) and levenshtein(a, b, 1) = 1"
    # an inserted letter beside its equals can be found by two keys
    return chunks.join(grams, "_key").where(near).select("a", "a_n", "b", "b_n").distinct()


def variants(vocabulary: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``vocabulary`` (word, n)."""
    known = cut_lineage(vocabulary)
    pairs = links(known)
    sides = "stack(2, a, a_n, b, b_n, b, b_n, a, a_n) as (word, n, near, near_n)"
    best = (
        pairs.selectExpr(sides)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.expr("min(struct(-near_n as less, near))").alias("_best"))
    )
    formed = cut_lineage(
        known.join(best, "word", "left")
        .selectExpr("*", f"coalesce(-_best.less >= {ratio} * n, false) as _has")
        .selectExpr(
            "word",
            "n",
            "coalesce(n_near, 0L) as n_near",
            "if(_has, _best.near, null) as form",
            "if(_has, -_best.less, null) as form_n",
        )
    )
    paths = formed.where("form is not null").selectExpr("word", "form as root")
    while True:
        further = paths.selectExpr("word as root", "root as _next")
        stepped = cut_lineage(
            skew_join(paths, further, ["root"], "left").selectExpr("word", "coalesce(_next, root) as root", "_next is not null as _moved")
        )
        paths = stepped.select("word", "root")
        if stepped.where("_moved").isEmpty():
            break
    return formed.join(paths, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) as root", "n", "n_near", "form_n"
    )
