"""From raw documents to token digests in five stages over one corpus.

Every stage gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``; the last returns, for each
document of the mix (repeats included), the digests of its ids and decoded text.

Defined results, for every stage but the last: rows keep all columns, whatever
their names; an empty table stays empty.  Null and empty texts have no language
and go in the first stage.  Repeated rows are judged alike by the first two
stages; the third keeps one of them.  A null doc_id is an id of its own for the
third stage, behind all others of its group.  Ties between documents of a group
go to the smallest id, ties in the order of the mix to a hash of all columns, so
reruns agree.  Near duplicates are taken on shingles of five words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bbit_minhash, bpe_tree, language_mixture, quality_rules, source_mixing
from tidewater.llm.queries import tokenizer_path
from tidewater.llm.shared import materialise
from tidewater.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined, dominant language go."""
    ship(spark)
    return language_mixture.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the threshold table go."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at 0.8 or more."""
    ship(spark)
    return bbit_minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as systematic sampling takes them."""
    return source_mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(spark)
    return bpe_tree.encode_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the language mixture, the near-duplicate search and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
