"""Fusing ranked lists, hybrid search, reranking and late materialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.text import base_name, plain_tokens, snippet, tokens

RRF_K, POOL = 60, 50


def ranked(leg: DataFrame, id_col: str, *order) -> DataFrame:
    """id, rank (from 1) of a list that is short by construction."""
    return leg.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(*order, id_col)).alias("rank"))


def rrf(legs: list[DataFrame], k: int = RRF_K, limit: int = 10) -> DataFrame:
    """id, score: sum of 1 / (k + rank); the legs' own scores do not matter."""
    k, limit = (k if k > 0 else RRF_K), (limit if limit > 0 else 10)
    every = reduce(DataFrame.unionByName, legs)
    fused = every.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def hydrate(hits: DataFrame, texts: DataFrame, id_col: str, text_col: str, path, source: str = "local") -> DataFrame:
    """Attach text columns to a short list of hits: the list is broadcast (its
    size is the limit), the texts are read once and filtered by it."""
    rows = texts.withColumn("path_", path).select(F.col(id_col).alias("id"), "path_", F.col(text_col).alias("text_"))
    found = rows.join(F.broadcast(hits), "id")
    return found.select(
        "id", F.concat(base_name(F.col("path_")), F.lit(":1")).alias("title"), F.col("path_").alias("path"),
        snippet(F.col("text_")).alias("snippet"), "score", F.lit(source).alias("source"),
    )


def lexical_rerank(hits: DataFrame, texts: DataFrame, id_col: str, text_col: str, query: str, top_n: int) -> DataFrame:
    """id, score: share of the query's distinct tokens that the text holds."""
    wanted = sorted(set(plain_tokens(query)))
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_")).join(F.broadcast(hits.select("id")), "id")
    share = F.size(F.array_intersect(tokens(F.col("text_")), F.array(*[F.lit(t) for t in wanted]))) / F.lit(float(len(wanted)))
    return rows.select("id", F.round(share, 6).alias("score")).orderBy(F.desc("score"), "id").limit(top_n)


def apply_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by position (index, score) replace those of the hits, in the
    scores' order; positions outside the list are dropped."""
    at = Window.orderBy(F.desc("score"), "id")
    placed = hits.withColumn("index", F.row_number().over(at) - 1).drop("score")
    return placed.join(F.broadcast(scores), "index")
