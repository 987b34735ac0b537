"""Line search within files: substring counting over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.text import line_terms, substring_count


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 1), text: carriage returns at line ends go, as does a last
    empty line."""
    parts = F.split(F.regexp_replace(F.col(text_col), r"\n\z", ""), "\n")
    out = docs.where(F.length(text_col) > 0).select(id_col, F.posexplode(parts).alias("pos", "text"))
    return out.select(id_col, (F.col("pos") + 1).alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))


def score_line(text: Column, terms: list[str], case_sensitive: bool) -> tuple[Column, Column]:
    """(score, number of matched terms): counts of all terms, plus two if every
    term occurs; a repeated term counts again."""
    own = text if case_sensitive else F.lower(text)
    counts = [substring_count(own, F.lit(t)) for t in terms]
    n = sum((F.when(c > 0, 1).otherwise(0) for c in counts[1:]), F.when(counts[0] > 0, 1).otherwise(0))
    total = sum(counts[1:], counts[0])
    return total + F.when(n == len(terms), 2).otherwise(0), n


def line_search(docs: DataFrame, id_col: str, text_col: str, query: str, limit: int | None = 10, case_sensitive: bool = False, per_doc: int | None = None, with_text: bool = False) -> DataFrame:
    """id, line, score, n_terms (and the line's text, if asked for) of matching lines, best first."""
    terms = line_terms(query, case_sensitive)
    if not terms:
        raise ValueError("query has no searchable terms")
    score, n = score_line(F.col("text"), terms, case_sensitive)
    # any term first: most lines end there
    own = F.col("text") if case_sensitive else F.lower("text")
    found = lines(docs, id_col, text_col).where(sum((own.contains(t).cast("int") for t in terms[1:]), own.contains(terms[0]).cast("int")) > 0)
    hits = found.select(id_col, "line", score.alias("score"), n.alias("n_terms"), *(["text"] if with_text else []))
    order = [F.desc("score"), F.desc("n_terms"), F.asc("line")]
    if per_doc is not None:
        place = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
        return hits.withColumn("place", place).where(F.col("place") <= per_doc)
    return hits.orderBy(*order, id_col).limit(limit or 10)
