"""Vector search, the deterministic hashing embedder, and the embedder protocol."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import let, plain_tokens, tokens
from tidewater.functions.vectors import cosine


class Embedder(Protocol):
    """What an embedding model has to offer; it is sent to the executors."""

    model: str

    def encode_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic embedder without a model: hashed tokens, L2-normalised."""

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"hash-{dim}"

    def encode_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for t in plain_tokens(text):
                v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % self.dim] += 1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm if norm else 0.0 for x in v])
        return out


def top_k(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], k: int) -> DataFrame:
    """Exact cosine top-k. The query is a literal, vectors of other dimension are
    ignored, every task keeps k rows and only those meet."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.where(F.size(vec_col) == len(query)).select(id_col, F.round(cosine(F.col(vec_col), q), 6).alias("score"))
    return near.orderBy(F.desc("score"), id_col).limit(k)


def hash_embed(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """id, dim, value: bag of hashed tokens, L2-normalised, as coordinates."""
    def bucket(term: Column) -> Column:
        return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")

    def counts(b: Column) -> Column:  # a row has at most *dim* distinct buckets
        return F.transform(F.array_distinct(b), lambda d: F.struct(d.alias("dim"), (F.size(b) - F.size(F.array_remove(b, d))).alias("v")))

    counted = docs.select(id_col, let(F.transform(tokens(F.col(text_col)), bucket), counts).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + (x["v"] * x["v"]).cast("double")))
    rows = counted.select(id_col, norm.alias("norm"), F.explode("c").alias("x"))
    return rows.select(id_col, "x.dim", F.round(F.col("x.v") / F.col("norm"), 6).alias("value"))


def embed_with(docs: DataFrame, id_col: str, text_col: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """chunk_id, embedding through any model, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for a in range(0, len(texts), batch):
                some = texts.iloc[a : a + batch].tolist()
                vectors = embedder.encode_batch(some)
                if len(vectors) != len(some):
                    raise ValueError(f"embedder gave {len(vectors)} vectors for {len(some)} texts")
                out += vectors
            yield pd.Series(out)

    return docs.select(F.col(id_col).alias("chunk_id"), encode(F.col(text_col)).alias("embedding"))


def backfill(chunks: DataFrame, vectors: DataFrame, id_col: str, vec_id: str) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select(F.col(vec_id).alias(id_col)), id_col, "left_anti")
