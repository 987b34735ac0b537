"""Mixing sources to target weights by systematic sampling (DataFrame only).

Every document of a source has the same expected number of copies, target words
over source words.  Documents are put in order within their source, the
expected copies are summed up along that order, one offset per source is added,
and a document is emitted once for every integer boundary that its step
crosses.  The order follows the size of the documents, so documents emitted
more or less often than expected alternate with neighbours of nearly the same
size, and the words taken stay within about one document of the target.

How it scales: a step only needs the document's rank in its source.  Ranks come
from two levels: rows are counted by cell (source, size class, hash slot), cells
are summed up within their source, and rows are ranked within their cell, so a
source or a size with a third of all rows is spread over ``slots`` tasks.

Defined results: a null text has size 0; a null source is a source of its own,
the last one; sources without words have target 0 and nothing is taken from
them; equal rows are separate documents; an empty table gives an empty result;
other columns of the input may have any name (they are kept apart in a struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from tidewater.llm.shared import materialise, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """*df* with, for each name of *sums*, the sum of its expression over the
    rows before in the order: rows are parted by ranges of the order and summed
    up within their part; what the parts before hold is added (one row a part)."""
    parts = materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("part").agg(*[F.sum(x).alias(f"{k}_") for k, x in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(f"{k}_").over(earlier), F.lit(0)).alias(f"{k}_") for k in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.select("*", *[F.coalesce(F.sum(x).over(within), F.lit(0)).alias(k) for k, x in sums.items()])
    added = [(F.col(k) + F.col(f"{k}_")).alias(k) for k in sums]
    return own.join(totals, "part").select(*df.columns, *added)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Filling up by weight with a ceiling: sorted by ceiling over weight, the
    sources before the turning point stop at their ceiling, the others share
    the rest in proportion to their weights.  Places and sums along an order of
    the sources come from ranges of it, so there may be any number of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _running(per, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    per = per.select("source", "source_size", "weight", (F.col("source_size") * max_copies).alias("ceiling"))
    per = per.withColumn("turn", F.col("ceiling") / F.col("weight"))
    per = materialise(_running(per, [F.col("turn").asc(), F.col("source").asc_nulls_last()], {"filled": F.col("ceiling"), "weights": F.col("weight")}), "sources")
    size, weight = per.agg(F.sum("source_size")).scalar(), per.agg(F.sum("weight")).scalar()
    per = per.withColumn("level", (size - F.col("filled")) / (weight - F.col("weights")))
    open_ = F.col("ceiling") > F.col("level") * F.col("weight")
    share = per.agg(F.max(F.when(open_, F.col("level")))).scalar()
    return per.select("source", "source_size", F.when(open_, share * F.col("weight")).otherwise(F.col("ceiling").cast("double")).alias("target"))


def size_class(size: Column) -> Column:
    """Classes of sizes that differ by a 32nd at most: bit length and the next five bits."""
    bits = F.length(F.bin(size))
    return bits * 32 + F.conv(F.substring(F.rpad(F.bin(size), 6, "0"), 2, 5), 2, 10).cast("int")


def slot_of(doc_id: Column, slots: int) -> Column:
    """Hash slot of a document: from its md5, so that plain SQL can follow it."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def offset_of(source: Column, seed: int) -> Column:
    """The random offset of a source: a multiple of 1/1024, exact in sums."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null")))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") % 1024) / F.lit(1024.0)


def _sizes(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size) as a written table: it is used several times, the
    texts are read once for it."""
    return materialise(docs.select(F.col("source").cast("string").alias("source"), "doc_id", word_count(F.col("text")).alias("size")), "sizes")


def copies(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7, slots: int = 512) -> DataFrame:
    """row (a struct of all columns of *docs*), size, source_size, target, copies."""
    light = _sizes(docs)
    tie = F.xxhash64(*[docs[f.name] for f in docs.schema if not isinstance(f.dataType, MapType)]).alias("tie")  # maps have no hash
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), tie)
    return _with_copies(rows, light, weights, max_copies, seed, slots)


def _with_copies(rows: DataFrame, light: DataFrame, weights, max_copies: int, seed: int, slots: int) -> DataFrame:
    """*rows* and *light* hold the same rows; *light* only (source, doc_id, size)."""

    def in_cells(df: DataFrame) -> DataFrame:
        return df.withColumn("class", size_class(F.col("size"))).withColumn("slot", slot_of(F.col("doc_id"), slots))

    cell = ["source", "class", "slot"]
    cells = in_cells(light).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("source", "class").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_class = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.select(F.col("source").alias("s_"), F.col("class").alias("c_"), F.coalesce(F.sum("n").over(classes), F.lit(0)).alias("class_base"))
    cells = cells.join(by_class, cells["source"].eqNullSafe(F.col("s_")) & (cells["class"] == F.col("c_")))
    cells = cells.select(
        F.col("source").alias("s_"), F.col("class").alias("c_"), F.col("slot").alias("t_"),
        (F.col("class_base") + F.coalesce(F.sum("n").over(running), F.lit(0))).alias("base"),
    )
    targets = source_targets(light.select("source", "size"), weights, max_copies).withColumnRenamed("source", "s_")

    ranked = in_cells(rows).withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", *(["tie"] if "tie" in rows.columns else []))).cast("long") - 1)
    ranked = ranked.join(cells, ranked["source"].eqNullSafe(cells["s_"]) & (ranked["class"] == cells["c_"]) & (ranked["slot"] == cells["t_"])).drop("s_", "c_", "t_")
    ranked = ranked.join(targets, ranked["source"].eqNullSafe(targets["s_"])).drop("s_")
    rate = F.least(F.lit(float(max_copies)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    at = F.col("base") + F.col("rank")
    crossed = F.floor(rate * (at + 1) + offset_of(F.col("source"), seed)) - F.floor(rate * at + offset_of(F.col("source"), seed))
    return ranked.withColumn("copies", F.least(F.lit(max_copies), crossed).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    opts = {"weights": WEIGHTS, "max_copies": MAX_COPIES, "seed": 7, "slots": 512} | options
    light = _sizes(docs)
    out = _with_copies(light, light, **opts)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of *docs* as often as it is taken, same columns."""
    picked = copies(docs, **options).where(F.col("copies") > 0)
    return picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
