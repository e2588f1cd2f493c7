"""A training-data pipeline over ``documents``: language, exact and near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Null texts have no language and go with the first stage. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge.llm import bpe, exact, langid, mixing, simhash
from slotforge.llm.common import fold, materialize

#: Documents whose language is less certain than this are rejected, as are those without one.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; ``lang`` becomes the predicted one."""
    model = langid.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model, whole=True).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CERTAIN))
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id; of rows tied on both, one."""
    return exact.keep_one(docs, keep="smallest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; ties are settled by row, never by id alone."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights in expectation."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(docs, vocabulary))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: A trained model, iterated proportions and connected components: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = materialize(docs, name)
    return docs
