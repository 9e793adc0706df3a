"""Corpus pipeline: documents without toxic ones and copies, mixed by source, as tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it to the
folder that the cluster shares and reads it back for the next stage.  All stages but the
last return the columns of ``documents``; the last one returns one row per document that is left.
Nulls, repeated rows, empty tables and further columns are treated as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endsight.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from endsight.llm.common import remainder, shared_folder, table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; two thirds of the labels are learned from."""
    learn = remainder("doc_id", 3) != 1
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each text."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots: the order of the written files is the mix."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and checksums of ids and decoded text."""
    encoded = bpe.encode(docs, vocabulary())
    return encoded.select(
        F.col("_id").alias("doc_id"), F.col("_ids").alias("ids"), *bpe.digest_columns()
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: Learned scores, hashed sketches and byte-pair merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
