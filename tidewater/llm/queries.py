"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bbit_minhash, block_text, bpe_tree, graph_search, language_mixture, quality_rules, ring_sharding, source_mixing, token_grammar, warc_members
from tidewater.llm.oracles import ORACLES
from tidewater.llm.shared import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_mixture.identify(docs, language_mixture.fit(docs))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard(table(spark, sf_dir, "documents"))


def op3_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_grammar.store(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.detect(table(spark, sf_dir, "documents"))


def op5_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_members.archive(table(spark, sf_dir, "pages"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"))


def op8_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_language_mixture, op2_ring_sharding, op3_token_grammar, op4_bbit_minhash, op5_warc_members,
        op6_bpe_tree, op7_graph_search, op8_block_text, op9_source_mixing, op10_quality_rules,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
