"""Registered queries of this folder: thin digests of the operators' results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from endsight.llm import (
    bpe,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    periodic_runs,
    pii,
    quality,
    repeated_passages,
    sharding,
    spelling,
    token_counts,
    toxicity,
)
from endsight.llm.common import remainder, shared_folder, table, vocabulary
from endsight.operators.scale import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Trained on the two thirds of ``docs`` and of the labels that may be learned from."""
    open_to_learning = remainder("doc_id", 3) != 1
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs.where(open_to_learning), labels.where(open_to_learning))


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, sf_dir, docs)
    scored = docs.select("doc_id", toxicity.scorer(docs, model).alias("score"))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.expr(f"int(score >= {toxicity.THRESHOLD})").alias("predicted"),
    )


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "_id as doc_id",
        *[f"bigint(size(filter(_base, x -> x.k = {i}))) as n_{k}" for i, k in enumerate(pii.KINDS)],
        f"sha2({pii.listed('_base')}, 256) as base_sha256",
        f"{pii.listed('_spans')} as spans",
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.selectExpr(
        "_id as doc_id",
        "_size as size",
        "_crc as text_crc32",
        "'rows' as law",
        "_shard as shard",
        "_slot as slot",
        "int(null) as grown_shard",
        "_row as row_number",
    )


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("_key")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: load all documents under two versions, revise the counts of
    low-quality documents to letter words, delete toxic documents, and send the deletes again."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = cut_lineage(
        docs.selectExpr(
            "doc_id", "source", "lang", *[f"{token_counts.count_tokens('text', v)} as {v}" for v in token_counts.VERSIONS]
        )
    )
    marked = counted.join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    revised = "if(quality = 0, letters, words)"
    load = [token_counts.changes(counted, "insert", new=v, version=v) for v in ("words", "pieces")]
    revise = token_counts.changes(marked.where("quality = 0"), "revise", old="words", new="letters", version="words")
    toxic = marked.where("toxic = 1")
    delete = [
        token_counts.changes(toxic, "delete", old=revised, version="words"),
        token_counts.changes(toxic, "delete", old="pieces", version="pieces"),
    ]
    rollup = token_counts.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", load[0].unionByName(load[1]))
    rollup.commit("revise", revise)
    rollup.commit("delete", delete[0].unionByName(delete[1]))
    rollup.commit("delete", delete[0].unionByName(delete[1]))
    return rollup.totals()


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, window and slot of every document."""
    return mixing.schedule(table(spark, sf_dir, "documents")).selectExpr(
        "_id as doc_id",
        "_source as source",
        "_block as block",
        "_phase as phase",
        "_release as release",
        "_deadline as deadline",
        "_slot as slot",
    )


def op7_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document and the row of each group that stays."""
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op8_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    predicted = language_id.predict(docs, model)
    return predicted.select(
        F.col("_id").alias("doc_id"),
        (remainder("_id", 4) == 2).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


def op9_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, perplexity and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).selectExpr(
        "_id as doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_perplexity",
    )


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded text of every document."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    return encoded.select(F.col("_id").alias("doc_id"), *bpe.digest_columns())


def op11_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated strings of 100 bytes are removed."""
    return repeated_passages.remove_repeats(table(spark, sf_dir, "documents")).selectExpr(
        "_id as doc_id",
        "_n_bytes as n_bytes",
        "_n_removed as n_removed",
        "bigint(size(_spans)) as n_spans",
        "sha2(_kept, 256) as kept_sha256",
    )


def op12_qchunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of at least 7 letters."""
    docs = table(spark, sf_dir, "documents")
    return spelling.variants(spelling.words(docs, derive=spelling.dropped_letter))


def op13_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, with the contract's planted ones."""
    found = periodic_runs.find(table(spark, sf_dir, "documents"), derive=periodic_runs.planted)
    line = "concat(r.start, ',', r.length, ',', r.period, '\n')"
    return found.selectExpr(
        "_id as doc_id",
        "bigint(size(_runs)) as n_runs",
        "_best.start as start",
        "_best.length as length",
        "_best.period as period",
        "1000 * _best.length div _best.period as exponent_milli",
        f"sha2(array_join(transform(_runs, r -> {line}), ''), 256) as runs_sha256",
        "sha2(_kept, 256) as collapsed_sha256",
    )


OP3_SQL = """
with recursive
steps as materialized (select list(c order by i) as t from (
  select i, list_reduce(list_prepend(i::bigint, [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
bytes as (select doc_id, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
    lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1) as b,
    coalesce(strlen(text), 0) + 1 as size from documents),
d as materialized (select doc_id, size::bigint as size,
    xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, steps.t[(xor(c, x) & 255) + 1])), 4294967295) as crc,
    row_number() over (order by doc_id nulls first) - 1 as n, count(*) over () as total from bytes, steps),
m as materialized (select *, ceil(total / ceil(sqrt(total)))::bigint as q, ceil(sqrt(total))::bigint as p from d),
w as (select doc_id, total, p, q, n // q as l, n % q as r, 0 as i from m
  union all
  select doc_id, total, p, q,
    case when i % 2 = 0 then (l + ('0x' || substr(md5('0:' || i % 6 || ':' || r), 1, 12))::bigint) % p else l end,
    case when i % 2 = 1 then (r + ('0x' || substr(md5('0:' || i % 6 || ':' || l), 1, 12))::bigint) % q else r end,
    i + 1 from w where i % 6 <> 0 or i = 0 or l * q + r >= total)
select m.doc_id, size, crc::bigint as text_crc32, 'rows' as law, ((l * q + r) % 8)::int as shard, ((l * q + r) // 8)::bigint as slot,
  null::int as grown_shard, n::bigint as row_number
from m join (select doc_id, l, r from w where i > 0 and i % 6 = 0 and l * q + r < total) using (doc_id)
"""

OP5_SQL = """
with c as materialized (
  select doc_id, source, lang,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as words,
    coalesce(len(regexp_extract_all(text, '\\p{L}+|\\p{N}|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]+')), 0) as pieces,
    coalesce(len(regexp_extract_all(text, '\\p{L}+')), 0) as letters
  from documents),
m as (select c.*, quality, toxic from c join labels using (doc_id)),
f as (
  select source, lang, 'words' as tokenizer_version, 1 as docs, words as tokens from c
  union all select source, lang, 'pieces', 1, pieces from c
  union all select source, lang, 'words', 0, letters - words from m where quality = 0
  union all select source, lang, 'words', -1, -case when quality = 0 then letters else words end from m where toxic = 1
  union all select source, lang, 'pieces', -1, -pieces from m where toxic = 1)
select source, lang, tokenizer_version, sum(docs)::bigint as docs, sum(tokens)::bigint as tokens
from f group by all having sum(docs) <> 0 or sum(tokens) <> 0
"""

OP7_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as n
  from documents),
e as (select doc_id, length(t) as chars, sha256(n) as sha from d)
select doc_id,
  first(doc_id) over w as keep_id,
  count(*) over (partition by sha) as group_size,
  row_number() over w = 1 as kept,
  sha as text_sha256
from e window w as (partition by sha order by chars desc, doc_id nulls last)
"""

OP11_SQL = """
with d as materialized (select doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
q as materialized (select doc_id, n, f, substr(h, 2 * f + 1, 2200) as h from (select *, unnest(range(0, n, 1000)) as f from d)),
p as (select doc_id, n, f, h, unnest(range(least(1000, n - f))) as j from q),
w as materialized (select doc_id, f + j as i, case when f + j + 100 <= n then md5_number(substr(h, 2 * j + 1, 200)) end as b, substr(h, 2 * j + 1, 2) as x from p),
m as (select b, min((doc_id, i)) as first from w where b is not null group by b),
r as (select doc_id, i, x, coalesce(first <> (doc_id, i), false) as later from w left join m using (b)),
c as (select doc_id, i, x, coalesce(bool_or(later) over (partition by doc_id order by i rows between 99 preceding and current row), false) as gone from r),
o as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
k as (select doc_id, count_if(gone) as n_removed, count_if(opens) as n_spans,
  coalesce(string_agg(x, '' order by i) filter (not gone), '') as kept from o group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join k using (doc_id)
"""

OP12_SQL = r"""
with recursive
steps as materialized (select list(c order by i) as t from (
  select i, list_reduce(list_prepend(i::bigint, [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
u as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
g as materialized (select doc_id, run, count(*) as n from u group by all),
b as (select *, list_transform(regexp_extract_all(hex(coalesce(doc_id::varchar, '') || ':' || run), '..'),
  lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1) as b from g),
h as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, steps.t[(xor(c, x) & 255) + 1])), 4294967295) as h
  from b, steps),
e as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from h),
w as materialized (select word, sum(n)::bigint as n from e where length(word) >= 7 group by word having sum(n) >= 2),
x as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as cut from (select word, n, unnest(range(length(word))) as i from w)),
near as (select a.word, b.word as near, b.n as near_n from x a join x b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select x.word, w.word, w.n from x join w on x.cut = w.word
  union select w.word, x.word, x.n from x join w on x.cut = w.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form,
  case when near_n >= 10 * n then near_n end as form_n from w left join best using (word)),
walk as (select word, word as root, form as next from f
  union all select walk.word, f.word, f.form from walk join f on f.word = walk.next)
select f.word, f.form, walk.root, f.n, f.n_near::bigint as n_near, f.form_n
from f join walk on f.word = walk.word and walk.next is null
"""

QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_order_minhash": op4_order_minhash,
    "op5_token_rollup": op5_token_rollup,
    "op6_pfair_mix": op6_pfair_mix,
    "op7_patricia_owners": op7_patricia_owners,
    "op8_word_backoff": op8_word_backoff,
    "op9_kneser_ney_bands": op9_kneser_ney_bands,
    "op10_prefix_bpe": op10_prefix_bpe,
    "op11_prefix_free_parsing": op11_prefix_free_parsing,
    "op12_qchunk_variants": op12_qchunk_variants,
    "op13_repair_runs": op13_repair_runs,
}

ORACLES: dict[str, str] = {
    "op3_feistel_shards": OP3_SQL,
    "op5_token_rollup": OP5_SQL,
    "op7_patricia_owners": OP7_SQL,
    "op11_prefix_free_parsing": OP11_SQL,
    "op12_qchunk_variants": OP12_SQL,
}
