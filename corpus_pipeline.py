"""From raw documents to token ids: five stages over the table `documents`, each on all that the one before it kept.

1. quality      the factorisation machine drops documents that score below its threshold
2. near_dedup   of each group of SimHash near-duplicates the document with the smallest doc_id stays
3. pii          spans of personal data are replaced by their kind in brackets
4. mix          entropy balancing decides how often each document is taken; a row a copy
5. encode       byte-level BPE ids, and the text decoded from them

The first four return the columns of documents. An empty table runs through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, pii, quality, simhash
from lodestone.llm.queries import RANKS
from lodestone.llm.shared import discard, written, written_alone  # noqa: F401


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), text decoded from the ids."""
    both = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN).drop("text"), RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality", _quality), ("near_dedup", _near_dedup), ("pii", _pii), ("mix", _mix), ("encode", _encode)]

#: Fitted weights, components and Newton steps have no SQL form; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage is written to the shared folder and read again, what it needed on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
