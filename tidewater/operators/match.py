"""Full-text match: tokens, postings, phrases and BM25.

Every operator takes documents as (id, text) and works in one pass over the
texts with built-in expressions.  Corpus statistics are one row; they reach the
rows as a scalar side of known size.  Only tokens of the query are expanded.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import let, query_phrases, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokenize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.size(tokens(F.col(text_col))).alias("n_tokens"))


def term_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df, cf: a row's distinct tokens count for df and all for cf, both in
    one aggregation by term that combines on the map side."""

    def marks(t: Column) -> Column:
        return F.concat(
            F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))),
            F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))),
        )

    every = docs.select(F.explode(let(tokens(F.col(text_col)), marks)).alias("x"))
    return every.groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.c").alias("cf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    n = F.size(tokens(F.col(text_col)))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n).alias("avgdl"))


def postings(docs: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """term, id, positions (ascending, from 0), for all or some terms.

    The rows of one document lie in one partition, so most of the gathering
    happens before the shuffle, and a group is no larger than its document."""
    out = docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))
    if terms is not None:
        out = out.where(F.col("term").isin(terms))
    return out.groupBy("term", id_col).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """Start positions at which the tokens of the phrase follow each other."""
    if not phrase:
        return F.lit(0)

    def starts(_: Column, i: Column) -> Column:
        hit = F.get(toks, i) == phrase[0]
        for k, t in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(toks, i + k) == t, F.lit(False))
        return hit

    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    return F.size(F.filter(toks, starts))


def phrase_search(docs: DataFrame, id_col: str, text_col: str, phrase: list[str]) -> DataFrame:
    counted = docs.select(id_col, let(tokens(F.col(text_col)), lambda t: phrase_count(t, phrase)).alias("freq"))
    return counted.where("freq > 0")


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """id, score of the documents that match all phrases of the query.

    The score is negative and lower is better, as the engine this follows has it.
    """
    phrases = query_phrases(query)
    counts = let(tokens(F.col(text_col)), lambda t: F.struct(F.size(t).alias("dl"), *[phrase_count(t, p).alias(f"f{i}") for i, p in enumerate(phrases)]))
    rows = docs.select(F.col(id_col), counts.alias("c")).select(id_col, "c.*")
    stats = rows.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))],
    )
    matched = rows.where(" and ".join(f"f{i} > 0" for i in range(len(phrases)))).join(F.broadcast(stats))
    return matched.select(id_col, _bm25_score(len(phrases)).alias("score"))


def _bm25_score(n_phrases: int) -> Column:
    """From n_docs, avgdl, dl and, for each phrase, n<i> and f<i>."""
    score = F.lit(0.0)
    for i in range(n_phrases):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        raw = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return score


def _back(k: int, x: Column) -> Column:
    return x - k


BUCKETS = 64


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, positions, dl (tokens of the document), bucket: what a store
    keeps, laid out by bucket, so a query reads the buckets of its terms only."""

    def places(t: Column) -> Column:  # dl goes with each place: the array itself beside every token would be a copy a token
        return F.transform(t, lambda x, i: F.struct(F.size(t).alias("dl"), i.alias("pos"), x.alias("term")))

    out = docs.select(F.col(id_col).alias("id"), F.explode(let(tokens(F.col(text_col)), places)).alias("x")).select("id", "x.*")
    found = out.groupBy("term", "id", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.select("term", "id", "positions", "dl", term_bucket(F.col("term")).alias("bucket"))


def corpus_size(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: number of documents and of their tokens."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size(tokens(F.col(text_col)))), F.lit(0)).alias("n_tokens"))


def search_postings(found: DataFrame, corpus: DataFrame, query: str, limit: int, order: str = "relevance") -> DataFrame:
    """id, score as :func:`keyword_search` gives them, from stored postings.
    Rows of the query's terms meet by document; texts are not read."""
    phrases = query_phrases(query)
    terms = sorted({t for p in phrases for t in p})
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    here = found.where(F.col("term").isin(terms) & F.array_contains(F.transform(wanted, term_bucket), F.col("bucket")))
    # a word alone needs its count only; positions are shuffled for longer phrases
    alone = sorted({p[0] for p in phrases if len(p) == 1})
    within = sorted({t for p in phrases if len(p) > 1 for t in p})
    term = F.col("term")
    parts = [F.sum(F.when(term == t, F.size("positions"))).alias(f"c{i}") for i, t in enumerate(alone)]
    if within:
        parts.append(F.map_from_entries(F.collect_list(F.when(term.isin(within), F.struct("term", "positions")))).alias("at"))
    by_doc = here.groupBy("id", "dl").agg(F.count(F.lit(1)).alias("n_terms"), *parts)

    def frequency(phrase: list[str]) -> Column:
        if not phrase:
            return F.lit(0)
        if len(phrase) == 1:
            return F.coalesce(f"c{alone.index(phrase[0])}", F.lit(0))
        places = [F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>")) for t in phrase]
        hits = places[0]
        for k, p in enumerate(places[1:], 1):  # where the k-th token stands k places further on
            hits = F.array_intersect(hits, F.transform(p, partial(_back, k)))
        return F.size(hits)

    rows = by_doc.select("id", "dl", *[frequency(p).alias(f"f{i}") for i, p in enumerate(phrases)])
    stats = rows.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    stats = stats.join(F.broadcast(corpus.select("n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))))
    matched = rows.where(" and ".join(f"f{i} > 0" for i in range(len(phrases)))).join(F.broadcast(stats))
    scored = matched.select("id", F.round(_bm25_score(len(phrases)), 6).alias("score"))
    by = F.asc("score") if order == "relevance" else F.desc("score")
    return scored.orderBy(by, "id").limit(limit)


def keyword_search(docs: DataFrame, id_col: str, text_col: str, query: str, limit: int, order: str = "relevance") -> DataFrame:
    """Best matches first; ``order="reference"`` gives the largest (least
    relevant) scores first. Ties go to the smaller id, after rounding."""
    scored = bm25(docs, id_col, text_col, query).select(id_col, F.round("score", 6).alias("score"))
    by = F.asc("score") if order == "relevance" else F.desc("score")
    return scored.orderBy(by, id_col).limit(limit)
