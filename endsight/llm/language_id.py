"""Language identification: known words first, then ever shorter character n-grams.

Spark counts words per language over all training documents, and character n-grams over
the counted words.  A known word scores by its own log frequencies; any other word by the mean over its
known n-grams of the longest length that has any (4 letters, then 3, 2, 1, with marks at both ends); a word with none is silent.  A document sums
its words; ``score`` is the softmax of the sums over the square root of the word count.

Nothing counted is left out.  The ``WORDS`` most frequent words are broadcast, because most of a text consists of them;
the other words of each document, counted per document, meet the full tables of words and n-grams in joins.
The ``GRAMS`` most frequent n-grams score unknown words in tasks only where both lists hold everything.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no training row every text
is ``und``; ties go to the language that sorts first; repeated rows score
alike; null languages are not learned; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import settled, small_batches

#: Words and n-grams that are broadcast, longest n-gram, and the count added to each frequency.
WORDS, GRAMS, LONGEST, ADDED = 50_000, 100_000, 4, 0.5
#: Words whose scores a worker remembers before it starts afresh.
REMEMBERED = 200_000
_WORDS = "regexp_extract_all(lower(_text), '\\\\p{L}+', 0)"
_PARTIAL = pa.schema([("_lang", pa.string()), ("_gram", pa.string()), ("_count", pa.int64())])


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str], int] = Counter()

    def out() -> pa.RecordBatch:
        rows = [(lang, gram, n) for (lang, gram), n in sums.items()]
        sums.clear()
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _PARTIAL.types, strict=True)], schema=_PARTIAL
        )

    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    sums[lang, gram] += n
            if len(sums) > 300_000:
                yield out()
    yield out()


class Model:
    """Log frequencies of the broadcast words and n-grams, one column per language.

    ``tables`` has the full counts (words, n-grams) and their totals, or None where the lists are whole.
    """

    def __init__(
        self, languages: list[str], words: dict[str, np.ndarray], grams_: dict[str, np.ndarray], tables: tuple | None = None
    ) -> None:
        self.languages, self.words, self.grams, self.tables = languages, words, grams_, tables
        self.places: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))
        self.used = 0

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            found = [v for g in grams(word, n) if (v := self.grams.get(g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))

    def matrix(self, words: list[str]) -> np.ndarray:
        """Scores of ``words``, one row each."""
        if len(self.places) + len(words) > REMEMBERED:
            self.places.clear()
            self.used = 0
        fresh = [w for w in words if w not in self.places]
        if self.used + len(fresh) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), self.used + len(fresh)), len(self.languages)))
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        for i, w in enumerate(fresh, self.used):
            self.places[w] = i
            self.rows[i] = self.word(w)
        self.used += len(fresh)
        return self.rows[[self.places[w] for w in words]]


def _table(counts: pa.Table, totals: dict[str, float], languages: list[str]) -> dict[str, np.ndarray]:
    place = {lang: i for i, lang in enumerate(languages)}
    added = np.full(len(languages), ADDED)
    found: dict[str, np.ndarray] = {}
    for lang, key, n in zip(*(c.to_pylist() for c in counts.columns), strict=True):
        if key not in found:
            found[key] = added.copy()
        found[key][place[lang]] += n
    scale = np.log(np.array([totals[x] + ADDED for x in languages]))
    return {k: np.log(v) - scale for k, v in found.items()}


def _frequent(counts: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (_lang, key, _count) of the ``most`` keys with the highest totals, ties by key."""
    top = counts.groupBy(key).agg(F.sum("_count").alias("_total")).orderBy(F.desc("_total"), key).limit(most)
    return counts.join(F.broadcast(top.select(key)), key).select("_lang", key, "_count")


def _vectors(counts: DataFrame, key: str, totals: dict, languages: list[str]) -> DataFrame:
    """``key, _v``: log frequencies of every counted key, in the order of ``languages``; n-grams by their length."""
    spark = counts.sparkSession
    scales = [(n, [float(np.log(totals.get((x, n), 0.0) + ADDED)) for x in languages]) for n in sorted({k[1] for k in totals})]
    listed = F.array(*[F.lit(x) for x in languages])
    size = "length(_gram)" if key == "_gram" else "0"
    return (
        counts.groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("_lang", "_count"))).alias("_of"))
        .withColumn("_size", F.expr(size))
        .join(F.broadcast(spark.createDataFrame(scales, "_size int, _scale array<double>")), "_size")
        .withColumn("_languages", listed)
        .select(key, F.expr(f"zip_with(_languages, _scale, (x, s) -> ln(coalesce(_of[x], 0) + {ADDED}D) - s) as _v"))
    )


def _word_grams(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                words = whole.column(0).slice(start, 4096).to_pylist()
                pairs = [(w, g) for w in words for g in grams(w, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in pairs], pa.string()), pa.array([g for _, g in pairs], pa.string())],
                    names=["_word", "_gram"],
                )

    return run


def word_vectors(words: DataFrame, model: Model) -> DataFrame:
    """``_word, _v`` of the distinct ``words`` that have a score, from the full tables.

    Words that are not counted go through the lengths of n-grams from the longest; those that find a known one leave.
    """
    counted, gram_counts, totals, sizes = model.tables
    width = len(model.languages)
    found = settled(words.join(_vectors(counted, "_word", totals, model.languages), "_word", "left"))
    vectors, unknown = found.where("_v is not null"), found.where("_v is null").select("_word")
    known = _vectors(gram_counts, "_gram", sizes, model.languages)
    for size in range(LONGEST, 0, -1):
        backed = settled(
            unknown.mapInArrow(_word_grams(size), "_word string, _gram string")
            .join(known.where(F.length("_gram") == size), "_gram")
            .groupBy("_word")
            .agg(F.array(*[F.avg(F.col("_v")[i]) for i in range(width)]).alias("_v"))
        )
        vectors = vectors.unionByName(backed)
        unknown = settled(unknown.join(backed, "_word", "left_anti"))
    return vectors


def fit(training: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count words and n-grams of the rows of ``training`` that have a language."""
    rows = training.select(F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    words = settled(
        rows.where("_lang is not null and _text is not null")
        .selectExpr("_lang", f"explode({_WORDS}) as _word")
        .groupBy("_lang", "_word")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    parts = (
        words.mapInArrow(_count_grams, "_lang string, _gram string, _count bigint")
        .groupBy("_lang", "_gram")
        .agg(F.sum("_count").alias("_count"))
    )
    totals = {r[0]: float(r[1]) for r in words.groupBy("_lang").agg(F.sum("_count")).collect()}
    languages = sorted(totals)
    gram_counts = settled(parts)
    sizes = {
        (r[0], r[1]): float(r[2])
        for r in gram_counts.groupBy("_lang", F.length("_gram")).agg(F.sum("_count")).collect()
    }
    known = _table(_frequent(words, "_word", WORDS).toArrow(), totals, languages)
    tables = (words, gram_counts, {(x, 0): n for x, n in totals.items()}, sizes)
    known_grams: dict[str, np.ndarray] = {}
    frequent = _frequent(gram_counts, "_gram", GRAMS)
    for n in range(1, LONGEST + 1):
        of_size = {x: sizes.get((x, n), 0.0) for x in languages}
        known_grams |= _table(frequent.where(F.length("_gram") == n).toArrow(), of_size, languages)
    whole = words.select("_word").distinct().count() <= WORDS and gram_counts.select("_gram").distinct().count() <= GRAMS
    return Model(languages, known, known_grams, None if whole else tables)


_OUT = pa.schema([("_id", pa.int64()), ("_lang_pred", pa.string()), ("_score", pa.float64())])
_OUT_DDL = "_id bigint, _lang_pred string, _score double"
_SUMS = pa.schema(
    [("_id", pa.int64()), ("_n", pa.int64()), ("_sums", pa.list_(pa.float64()))]
    + [("_rest", pa.string()), ("_times", pa.list_(pa.int32()))]
)
_SUMS_DDL = "_id bigint, _n bigint, _sums array<double>, _rest string, _times array<int>"


def _add(broadcast, partial: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                summed = _summed(model, batch, partial)
                yield summed if partial else _chosen(model.languages, summed)

    return run


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat)


def _summed(model: Model, batch: pa.RecordBatch, partial: bool) -> pa.RecordBatch:
    """Sums over the words of each row; if ``partial``, those not broadcast are left to the joins, with their counts."""
    lists = batch.column(1)
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
    rows, width = batch.num_rows, len(model.languages)
    sums = np.zeros((rows, width))
    rest, times, of_row = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    if sizes.sum() and width:
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        table = np.zeros((len(words), width))
        here = np.array([not partial or w in model.words for w in words])
        table[here] = model.matrix([w for w, h in zip(words, here.tolist(), strict=True) if h])
        full = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        sums[full] = np.add.reduceat(table[codes], starts, axis=0)
        away = ~here[codes]
        pairs, times = np.unique(np.repeat(np.arange(rows), sizes)[away] * len(words) + codes[away], return_counts=True)
        of_row = np.bincount(pairs // len(words), minlength=rows)
        rest = coded.dictionary.take(pa.array(pairs % len(words)))
    away_lists = _lists(rest, of_row)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(sizes),
            _lists(pa.array(sums.ravel()), np.full(rows, width)),
            pc.binary_join(away_lists, " "),  # words have no blanks
            _lists(pa.array(times, pa.int32()), of_row),
        ],
        schema=_SUMS,
    )


def _choose(languages: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _chosen(languages, batch)

    return run


def _chosen(languages: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes = batch.column(1).to_numpy()
    predicted: list[str] = ["und"] * batch.num_rows
    score = np.zeros(batch.num_rows)
    full = np.flatnonzero(sizes)
    if len(full) and languages:
        sums = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, len(languages))[full]
        scaled = sums / np.sqrt(sizes[full])[:, None]
        chances = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        for i, best in zip(full.tolist(), chances.argmax(axis=1).tolist(), strict=True):
            predicted[i] = languages[best]
        score[full] = chances.max(axis=1)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(predicted, pa.string()), pa.array(score)], schema=_OUT)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _lang_pred, _score`` of every row; only the text is looked at."""
    small_batches(docs.sparkSession)
    # where words beyond the list go to the joins, tasks need no n-grams
    here = model.grams if model.tables is None else {}
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.languages, model.words, here))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))
    lists = rows.selectExpr("_id", f"{_WORDS} as _words")
    if model.tables is None:
        return lists.mapInArrow(_add(shared, False), _OUT_DDL)
    summed = settled(lists.mapInArrow(_add(shared, True), _SUMS_DDL).withColumn("_row", F.monotonically_increasing_id()))
    away = summed.where("_rest <> ''").selectExpr("_row", "split(_rest, ' ') as _word", "_times")
    rest = away.selectExpr("_row", "inline(arrays_zip(_word, _times))")
    vectors = word_vectors(rest.select("_word").distinct(), model)
    added = (
        rest.join(vectors, "_word")
        .groupBy("_row")
        .agg(F.array(*[F.sum(F.expr(f"_times * _v[{i}]")) for i in range(len(model.languages))]).alias("_more"))
    )
    whole = summed.select("_id", "_n", "_sums", "_row").join(added, "_row", "left")
    return whole.selectExpr(
        "_id", "_n", "if(_more is null, _sums, zip_with(_sums, _more, (x, y) -> x + y)) as _sums"
    ).mapInArrow(_choose(model.languages), _OUT_DDL)
