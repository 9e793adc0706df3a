"""Edge cases every operator defines: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import pytest
from pyspark.sql import functions as F

from endsight.llm import bpe, exact_dedup, language_id, mixing, near_dedup, pii, quality, sharding, toxicity
from endsight.llm.common import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _key string, score double, kept boolean, d string"
LONG = "the quick brown fox jumps over a lazy dog number " * 4000


def rows():
    plain = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "s"),
        (1, "alpha beta gamma delta epsilon zeta", "en", "s"),
        (None, "alpha beta  gamma delta epsilon zeta", "en", None),
        (2, None, None, None),
        (3, "", "en", "t"),
        (4, LONG, "de", "s"),
        (5, "x" * 20000, None, "t"),
        (None, None, None, None),
    ]
    return [(i, t, lang, src, len(t or ""), 7, "clash", "k", 0.5, True, "d") for i, t, lang, src in plain]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (99, None)], "doc_id long, toxic int")


def test_toxicity(docs, empty, labels):
    model = toxicity.fit(docs, labels)
    scored = docs.select(toxicity.scorer(docs, model).alias("s")).collect()
    assert len(scored) == 8 and all(0 <= r.s <= 1 for r in scored)
    kept = toxicity.reject(docs, model, threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == 8
    none = toxicity.fit(empty, labels.where("false"))
    assert {r.s for r in docs.select(toxicity.scorer(docs, none).alias("s")).collect()} == {0.0}
    assert toxicity.reject(empty, model).count() == 0


def test_personal_data(docs, empty):
    assert pii.spans(docs).where("size(_spans) > 0").count() == 0
    assert pii.spans(docs).count() == 8
    assert pii.spans(empty).count() == 0


def test_shards(docs, empty):
    placed = sharding.assign_shards(docs, shards=3).collect()
    assert len(placed) == 8 and sorted(r._row for r in placed) == list(range(8))
    assert sharding.assign_shards(empty).count() == 0


def test_near_duplicates(docs, empty):
    found = {(r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()}
    assert found == {(1, 1, 3), (None, 1, 3), (2, 2, 3), (3, 2, 3), (None, 2, 3), (4, 4, 1), (5, 5, 1)}
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert near_dedup.classes(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0


def test_mixing(docs, empty):
    mixed = mixing.mix(docs, block_rows=1)
    assert mixed.columns == docs.columns
    key = lambda r: (r.doc_id or -1, r.text or "", r.source or "")
    assert sorted(map(key, mixed.collect())) == sorted(map(key, docs.collect()))
    only = mixing.schedule(docs, {"s": 1.0, "t": 0.0}, block_rows=1)
    assert only.count() == 8 and {r._source for r in only.where("_phase = 1").collect()} == {"s"}
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_exact_copies(docs, empty):
    found = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.classes(docs).collect())
    # the null identifier owns the first group: its text has one code point more
    assert found == [
        (-1, -1, 3, True),
        (-1, 2, 3, False),
        (1, -1, 3, False),
        (1, -1, 3, False),
        (2, 2, 3, True),
        (3, 2, 3, False),
        (4, 4, 1, True),
        (5, 5, 1, True),
    ]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    twice = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (7, "a  b c d e f")], "doc_id long, text string")
    assert [r.kept for r in exact_dedup.classes(twice).collect()].count(True) == 1
    assert exact_dedup.deduplicate(twice).count() == 1
    assert [r.kept for r in near_dedup.classes(twice).collect()].count(True) == 1
    assert near_dedup.deduplicate(twice).count() == 1


def test_language(docs, empty):
    model = language_id.fit(docs)
    predicted = {(r._id, r._lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(2, "und"), (3, "und"), (1, "en"), (4, "de")} <= predicted
    untrained = language_id.fit(empty)
    assert {r._lang_pred for r in language_id.predict(docs, untrained).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_quality(docs, empty):
    judged = {r._id: r for r in quality.judge(docs.where("doc_id is not null")).collect()}
    assert judged[2].base_failed and judged[2].n_words == 0 and judged[2].log_perplexity is None
    assert not judged[3].kept and judged[4].n_words == 40000 and judged[4].base_failed
    assert quality.judge(empty).count() == 0


def test_tokens(docs, empty):
    encoded = bpe.encode(docs, vocabulary()).collect()
    assert len(encoded) == 8
    assert all(r._ids == [] and r._decoded == "" for r in encoded if r._id in (2, 3))
    assert bpe.encode(empty, vocabulary()).count() == 0


def test_columns_may_be_missing_values_only(spark):
    nothing = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert exact_dedup.deduplicate(nothing).count() == 1
    assert near_dedup.deduplicate(nothing).count() == 1
    assert mixing.mix(nothing).count() == 3
    assert quality.judge(nothing).agg(F.count_if("kept")).first()[0] == 0
