"""The corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Each stage works on all rows that the stage before it kept and is written as Parquet in the shared
folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultlens.llm import exact_dedup, langid, packing, pii, simhash
from faultlens.llm.common import land, table

#: A text's best language needs at least this calibrated probability (chance is 0.25 with four languages).
MIN_LANGUAGE_SCORE = 0.26


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose best language is hardly likelier than chance."""
    return langid.accepted(docs, langid.train(docs), MIN_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the smallest id stays."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash, the document with the smallest id stays."""
    return simhash.survivors(docs, shingle=4, radius=4)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets; ``n_chars`` follows the new text."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("packed", packed)]

#: Language prediction, SimHash, boosting and tokenisation are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
