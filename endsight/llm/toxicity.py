"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; everything else is unlabelled.  With class prior p
the risk of a classifier z under the logistic loss l is

    p E+[l(z)] + max(0, Eu[l(-z)] - p E+[l(-z)])

where the second term stands for the negatives that were never labelled; when its
estimate falls below zero the step goes the other way, so that the classifier does
not fit noise.  ``BAGS`` linear classifiers over word and word-part features are trained in numpy, each
in a task of its own on another two thirds of the positives and another share of the unlabelled texts; the
score of a text is the mean of their probabilities.

Prior and scale come from texts that a classifier has not seen: the prior is the least ratio of unlabelled to positive texts
above a cut (with a margin for small numbers), which needs no text labelled as clean.  Of all cuts the one with the best F1, as
estimated from that prior, is moved to ``THRESHOLD``.

Bounds, by parameter: about ``POSITIVES`` texts and ``UNLABELLED`` per classifier are drawn
by hash for the fit (distinct texts, so a large group of copies counts once), and a
classifier keeps at most ``FEATURES`` features.  Every text is scored whole.

Defined cases: a null or empty text has no features and gets the score of the bias; without any
positive the score of every text is 0; with too few to find a feature every text scores the prior; labels of documents that do not exist, and repeated
labels, change nothing; null labels and null identifiers are not learned from;
repeated rows score alike; other columns are carried, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import small_batches

#: Texts per classifier (expected), classifiers, features kept and hash space.
POSITIVES, UNLABELLED, BAGS, FEATURES, SPACE = 5_000, 10_000, 3, 4096, 1 << 20
#: A kept feature is this many times as frequent among positives, in at least so many of them.
LIFT, SUPPORT = 2.5, 4
#: Length of word parts; optimiser settings.
PART, EPOCHS, RATE, BATCH, DECAY = 5, 100, 0.05, 1024, 1e-4
THRESHOLD = 0.7
REMEMBERED = 200_000
_WORDS = "regexp_extract_all(lower({text}), '\\\\p{{L}}+', 0)"


def features(word: str) -> list[int]:
    """The word and its parts of ``PART`` letters, the first marked; hashed."""
    marked = "^" + word
    parts = [word + "$", *[marked[i : i + PART] for i in range(max(1, len(marked) - PART + 1))]]
    return [zlib.crc32(x.encode()) % SPACE for x in parts]


def _words(text: str) -> Column:
    return F.expr(_WORDS.format(text=text))


_SETS = pa.schema([("_positive", pa.bool_()), ("_key", pa.int64()), ("_features", pa.list_(pa.int32()))])


def _feature_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            sets = [sorted({f for w in words.as_py() or () for f in features(w)}) for words in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int32()))], schema=_SETS
            )


class Examples:
    """Sparse 0/1 rows: feature places one after another, with the end of each row."""

    def __init__(self, rows: list[np.ndarray], chosen: np.ndarray) -> None:
        kept = [np.searchsorted(chosen, r[np.isin(r, chosen)]) for r in rows]
        self.sizes = np.array([len(r) for r in kept], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.concatenate([*kept, np.zeros(0, dtype=np.int64)]).astype(np.int64)

    def take(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the picked rows and, beside each, the row's place in ``picked``."""
        sizes = self.sizes[picked]
        owner = np.repeat(np.arange(len(picked)), sizes)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.places[self.ends[picked][owner] + offset], owner


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features over-represented among the positives, the most significant first cut, sorted."""
    p, u = np.zeros(SPACE), np.zeros(SPACE)
    for counts, rows in ((p, positive), (u, unlabelled)):
        for row in rows:  # a row has a feature once
            counts[row] += 1
    share_p, share_u = p / len(positive), (u + 0.5) / (len(unlabelled) + 1)
    gain = (share_p - share_u) / np.sqrt(share_u / len(positive) + share_u / (len(unlabelled) + 1))
    fit = np.flatnonzero((p >= SUPPORT) & (share_p >= LIFT * share_u) & (gain > 4))
    return np.sort(fit[np.lexsort((fit, -gain[fit]))][:FEATURES])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 0):
    """(features, weights, bias) minimising the non-negative risk by Adam on mini-batches."""
    chosen = choose(positive, unlabelled)
    both = Examples(positive, chosen), Examples(unlabelled, chosen)
    counts = len(positive), len(unlabelled)
    random = np.random.default_rng(seed)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square, t = np.zeros_like(theta), np.zeros_like(theta), 0
    steps = max(1, -(-max(counts) // BATCH))
    for _ in range(EPOCHS):
        orders = [np.array_split(random.permutation(n), steps) for n in counts]
        for picks in zip(*orders, strict=True):
            sides = []
            for examples, picked in zip(both, picks, strict=True):
                place, owner = examples.take(picked)
                z = np.bincount(owner, theta[place], minlength=len(picked)) + theta[-1]
                sides.append((place, owner, z, max(1, len(picked))))
            (_, _, zp, np_), (_, _, zu, nu) = sides
            negative = np.logaddexp(0, zu).sum() / nu - prior * np.logaddexp(0, zp).sum() / np_
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # derivatives by z of the two terms
            if negative >= 0:
                slopes = (-prior * (1 - sp) - prior * sp) / np_, su / nu
            else:
                slopes = prior * sp / np_, -su / nu
            gradient = DECAY * theta
            for (place, owner, _, _), slope in zip(sides, slopes, strict=True):
                gradient[:-1] += np.bincount(place, slope[owner], minlength=len(chosen))
                gradient[-1] += slope.sum()
            t += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            theta = theta - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return chosen, theta[:-1], theta[-1]


#: Share of F1 by which cuts count as equally good.
SLACK = 0.01
#: Prior before it is estimated, its least and greatest value, and the margin's confidence.
PRIORS, CONFIDENCE = (0.1, 0.001, 0.5), 0.1


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the scores of unseen texts of both kinds."""
    first, least, most = PRIORS
    if not len(positive) or not len(unlabelled):
        return first
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = sum(np.sqrt(np.log(4 / CONFIDENCE) / (2 * n)) for n in (len(positive), len(unlabelled)))
    at = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[at] / above_p[at], least, most))


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bias: float) -> float | None:
    """Cut with the best estimated F1 among those that a text without features (score ``bias``) does not reach."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    cuts = cuts[cuts > bias + 1e-6]
    if not len(cuts) or not len(positive):
        return None
    recall = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    taken = 1 - np.searchsorted(np.sort(unlabelled), cuts) / max(1, len(unlabelled))
    # found / (taken + all): F1 with prior * recall as the share of true positives that are found
    f1 = 2 * prior * recall / (np.maximum(taken, prior * recall) + prior)
    if not f1.max() > 0:
        return None
    # the estimate is noisy: of cuts as good as the best, the one that finds most
    at = int(np.argmax(f1 >= (1 - SLACK) * f1.max()))
    # half way to the next lower cut, so that neither side lies on the edge
    return float((cuts[at] + (cuts[at - 1] if at else bias)) / 2)


def _scored(rows: list[np.ndarray], chosen: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    examples = Examples(rows, chosen)
    owner = np.repeat(np.arange(len(rows)), examples.sizes)
    return np.bincount(owner, weights[examples.places], minlength=len(rows)) + bias if len(rows) else np.zeros(0)


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], unseen: tuple[list, list], seed: int = 0):
    """(features, weights, bias) with the prior estimated on ``unseen`` texts and the best cut moved to ``THRESHOLD``."""
    prior = PRIORS[0]
    for _ in range(2):
        chosen, weights, bias = train(positive, unlabelled, prior, seed)
        held = [_scored(rows, chosen, weights, bias) for rows in unseen]
        prior = class_prior(*held)
    if not len(chosen):
        return chosen, weights, float(np.log(prior / (1 - prior)))
    cut = best_cut(*held, prior, bias)
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - cut if cut is not None else 0.0
    return chosen, weights, bias + shift


def _train_bag(bags: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # a fixed order makes the fit repeatable
        rows = rows.sort_values("_key", kind="stable")
        sets = [np.asarray(x, dtype=np.int32) for x in rows["_features"]]
        is_positive, keys = rows["_positive"].to_numpy(), rows["_key"].to_numpy()
        third = np.where(is_positive, (keys >> 7) % bags == int(key[0]), (keys >> 7) % 3 == 0)
        seen, unseen = [], []
        for part, wanted in ((seen, ~third), (unseen, third)):
            for kind in (is_positive, ~is_positive):
                part.append([sets[i] for i in np.flatnonzero(wanted & kind)])
        if not unseen[0] or not seen[0]:  # too few to set some aside
            seen[0] = unseen[0] = seen[0] + unseen[0]
        if not seen[0]:
            return pd.DataFrame({"_bag": [], "_feature": [], "_weight": []})
        chosen, weights, bias = fitted(*seen, tuple(unseen), int(key[0]))
        return pd.DataFrame(
            {
                "_bag": int(key[0]),
                "_feature": np.concatenate([chosen, [-1]]),
                "_weight": np.concatenate([weights, [bias]]),
            }
        )

    return run


class Model:
    """Sorted features with one weight per classifier, and the classifiers' biases."""

    def __init__(self, rows: list[tuple[int, int, float]]) -> None:
        bags = sorted({b for b, _, _ in rows})
        self.bias = np.array([next(w for b, f, w in rows if b == bag and f == -1) for bag in bags])
        place: dict[int, int] = {}
        for _, f, _ in sorted(rows, key=lambda r: r[1]):
            if f >= 0:
                place.setdefault(f, len(place))
        self.place = place
        self.weights = np.zeros((len(place), len(bags)))
        for b, f, w in rows:
            if f >= 0:
                self.weights[place[f], bags.index(b)] = w
        self.words: dict[str, tuple[int, ...]] = {}

    def hits(self, word: str) -> tuple[int, ...]:
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            place = self.place
            known = self.words[word] = tuple({place[f] for f in features(word) if f in place})
        return known

    def scores(self, lists: pa.ListArray) -> np.ndarray:
        n = len(lists)
        if not len(self.bias):
            return np.zeros(n)
        sizes = np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        hits = [self.hits(w) for w in coded.dictionary.to_pylist()]
        z = np.tile(self.bias, (n, 1))
        hit = np.array([bool(h) for h in hits], dtype=bool)
        codes = coded.indices.to_numpy()
        at = np.flatnonzero(hit[codes]) if len(codes) else np.zeros(0, dtype=np.int64)
        if len(at):
            owner = np.repeat(np.arange(n), sizes)[at].tolist()
            pairs = {(o, f) for o, c in zip(owner, codes[at].tolist(), strict=True) for f in hits[c]}
            rows, cols = np.array(sorted(pairs)).T
            np.add.at(z, rows, self.weights[cols])
        return (1 / (1 + np.exp(-z))).mean(axis=1)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    *,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    bags: int = BAGS,
) -> Model:
    """Train on documents and labels that may be learned from; both are used as given.

    Only labels of 1 are looked at; everything else counts as unlabelled.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(doc_id).cast("bigint").alias("_label_id"), F.col(toxic).cast("int").alias("_toxic"))
    marks = marks.where("_label_id is not null and _toxic is not null").distinct()
    toxic_rows = marks.where("_toxic = 1").count()
    if not toxic_rows:
        return Model([])
    grain = 1 << 30
    rate_p = int(grain * min(1.0, positives / toxic_rows))
    # expected to be at most ``positives`` rows whatever the size of the labels
    drawn = marks.where(f"_toxic = 1 and pmod(xxhash64(_label_id), {grain}) < {rate_p}").select("_label_id")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.where("_text is not null")
    rate_u = int(grain * min(1.0, bags * unlabelled / max(1, rows.count())))
    keyed = rows.withColumn("_key", F.expr("xxhash64(_text)"))
    certain = keyed.join(F.broadcast(drawn), F.expr("_id = _label_id")).selectExpr("true as _positive", "_key", "_text")
    others = keyed.where(f"pmod(_key, {grain}) < {rate_u}").selectExpr("false as _positive", "_key", "_text")
    sets = (
        certain.unionByName(others)
        .select("_positive", "_key", _words("_text").alias("_words"))
        .mapInArrow(_feature_sets, "_positive boolean, _key bigint, _features array<int>")
        .groupBy("_positive", "_key")
        .agg(F.first("_features").alias("_features"))
    )
    share = f"if(_positive, sequence(0, {bags - 1}), array(int(pmod(hash(_key), {bags}))))"
    trained = (
        sets.select("_positive", "_key", "_features", F.explode(F.expr(share)).alias("_bag"))
        .groupBy("_bag")
        .applyInPandas(_train_bag(bags), "_bag int, _feature int, _weight double")
    )
    return Model([tuple(r) for r in trained.collect()])


def scorer(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column with the score of ``text``, a column of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(words: pa.Array) -> pa.Array:
        found = [shared.value.scores(words.slice(i, 512)) for i in range(0, len(words), 512)]
        return pa.array(np.concatenate([*found, np.zeros(0)]))

    return score(_words(f"cast({text} as string)"))


def reject(docs: DataFrame, model: Model, text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    packed = docs.select(F.struct("*").alias("_row"))
    scored = packed.withColumn("_score", scorer(docs, model, f"_row.`{text}`"))
    return scored.where(F.col("_score") < threshold).select("_row.*")
