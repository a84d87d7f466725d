"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitmaps, bpe, chat, divergence, forest, html, mixing, neighbours, parsing, pii, quality, repeats, simhash
from .shared import written_alone

#: A name, not a path: every worker looks it up where the library lies on its machine.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alone(query):
    """query, its result written as a table and the tables that it needed on the way deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return written_alone(spark, lambda: query(spark, sf_dir), query.__name__)

    return run


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_fingerprint_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprints(_table(spark, sf_dir, "documents"))


def op3_mix_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(_table(spark, sf_dir, "documents"))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op6_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], given.schema)
    return chat.read_back(chat.expand(given.unionByName(own)))


def op8_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.digests(_table(spark, sf_dir, "documents"))


def op12_divergence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def op13_bitmap_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmaps.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Results as long as their texts are not written a second time.
WIDE = (op2_fingerprint_parsing, op6_site_style_tree)
QUERIES = {f.__name__: f if f in WIDE else _alone(f) for f in (op1_quality_fm, op2_fingerprint_parsing, op3_mix_entropy_balancing, op4_bootstrapped_pii, op5_anisotropic_search, op6_site_style_tree, op7_chat_prefix_targets, op8_maximal_repeats, op9_simhash_golay, op10_byte_bpe, op11_lsh_forest, op12_divergence_vectors, op13_bitmap_interactions)}
ORACLE_SQL = {
    "op7_chat_prefix_targets": chat.ORACLE_SQL,
    "op12_divergence_vectors": divergence.ORACLE_SQL,
    "op13_bitmap_interactions": bitmaps.ORACLE_SQL,
}
