"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame only).

Each shard owns ``vnodes`` points of a ring of 2**60 positions; a document's
key hashes to a position and belongs to the shard of the next point clockwise.
Shards have a capacity in rows.  Keys that meet a full shard continue clockwise
to the next shard with room.  Capacities are floor or ceil of the mean, so the
law is ``rows``: counts are at most one apart.  With many virtual nodes only
the surplus of each shard leaves its place on the ring; as there is no slack, a
further row or shard also moves rows near the borders of full shards.

How it scales: rows are only counted by ring arc (``shards * vnodes`` arcs, a
bound that does not depend on the data).  That table of arcs is poured into the
shards by one fold in ring order, which yields ranges of ranks within each arc.
Rows without their texts (id, size, checksum) are pre-aggregated, so equal rows
are one group with a count; groups are ranked within a slice of their arc (a
window over one of ``slices`` hash slices of one arc, so an id with a third of
all rows is spread), joined with the ranges by broadcast, whose size is bounded
as well, and a group's rows are dealt out again in pieces.

Defined results: a null text has size 1 and a null crc32; a null doc_id is
hashed as the text ``null``; rows that are equal in doc_id, size and checksum are
told apart only by their rank, so each gets a slot of its own; an empty table gives an empty result; columns of
the input other than doc_id and text are not looked at, so they cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.shared import materialise


def _point(shard: int, vnode: int) -> int:
    return int(hashlib.md5(f"shard-{shard}-{vnode}".encode()).hexdigest()[:15], 16)


def ring(shards: int, vnodes: int) -> tuple[list[int], list[list[int]]]:
    """The points of the ring in order, and for each the shards met clockwise."""
    points = sorted((_point(s, v), s) for s in range(shards) for v in range(vnodes))
    n, routes = len(points), []
    for k in range(n):
        route: list[int] = []
        step = 0
        while len(route) < shards:
            s = points[(k + step) % n][1]
            if s not in route:
                route.append(s)
            step += 1
        routes.append(route)
    return [p for p, _ in points], routes


def position(doc_id: Column) -> Column:
    """Ring position of a key: 60 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _arcs(spark, shards: int, vnodes: int) -> DataFrame:
    """The ring as a table made from the parameters alone: for every arc its
    route and the position interval (lo, hi], cut at the borders of as many
    equal slices of the ring as there are points, so that a position finds its
    arc by an equality on the slice and a comparison."""
    points, routes = ring(shards, vnodes)
    bits = max(1, (len(points) - 1).bit_length())
    width = 1 << (60 - bits)
    rows, lo = [], -1
    for k, hi in enumerate([*points, (1 << 60) - 1]):
        arc, start = k % len(points), lo
        for cut in range((start + 1) // width, hi // width + 1):
            rows.append((cut, max(start, cut * width - 1), min(hi, (cut + 1) * width - 1), arc, routes[arc]))
        lo = hi
    table = spark.createDataFrame(rows, "slice long, lo long, hi long, arc int, route array<int>")
    return table.withColumn("bits", F.lit(60 - bits))


def _pour(arcs: Column, shards: int) -> Column:
    """Fold arcs (arc, n, route) in ring order into segments (arc, shard, lo, hi):
    ranks lo (inclusive) to hi (exclusive) of the arc go to the shard."""
    total = F.aggregate(arcs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    room = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(total / shards).cast("long") + F.when(s < F.pmod(total, F.lit(shards)), 1).otherwise(0).cast("long"),
    )
    segment = "array<struct<arc:int,shard:int,lo:bigint,hi:bigint>>"
    start = F.struct(room.alias("room"), F.array().cast(segment).alias("out"))

    def one_arc(state: Column, x: Column) -> Column:
        def one_shard(s: Column, shard: Column) -> Column:
            take = F.least(s["left"], F.get(s["room"], shard))
            done = x["n"] - s["left"]
            moved = F.struct(
                (s["left"] - take).alias("left"),
                F.transform(s["room"], lambda v, i: F.when(i == shard, v - take).otherwise(v)).alias("room"),
                F.concat(s["out"], F.array(F.struct(x["arc"].alias("arc"), shard.alias("shard"), done.alias("lo"), (done + take).alias("hi")))).alias("out"),
            )
            return F.when(take > 0, moved).otherwise(s)

        begun = F.struct(x["n"].alias("left"), state["room"].alias("room"), state["out"].alias("out"))
        return F.aggregate(x["route"], begun, one_shard, lambda s: F.struct(s["room"].alias("room"), s["out"].alias("out")))

    return F.aggregate(arcs, start, one_arc, lambda s: s["out"])


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 256, slices: int = 256, piece: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    ring_table = _arcs(spark, shards, vnodes)
    shift = 60 - max(1, (shards * vnodes - 1).bit_length())
    borders = F.broadcast(ring_table.select("slice", "lo", "hi", "arc"))

    def on_ring(df: DataFrame) -> DataFrame:
        placed = df.withColumn("pos", position(F.col("doc_id"))).withColumn("slice", F.shiftright("pos", shift))
        return placed.join(borders, (placed["slice"] == borders["slice"]) & (F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi"))).drop("slice", "lo", "hi")

    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    groups = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "ring-groups")
    groups = on_ring(groups).withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int")).drop("pos")

    cells = groups.groupBy("arc", "slice").agg(F.sum("copies").alias("n"))
    counts = cells.groupBy("arc").agg(F.sum("n").alias("n"))
    routes = ring_table.groupBy("arc").agg(F.first("route").alias("route"))
    folded = routes.join(F.broadcast(counts), "arc").agg(F.sort_array(F.collect_list(F.struct("arc", "n", "route"))).alias("arcs"))
    segments = folded.select(F.inline(_pour(F.col("arcs"), shards)))
    before = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1))
    segments = segments.withColumn("base", F.coalesce(before, F.lit(0)))

    earlier = F.sum("n").over(Window.partitionBy("arc").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("arc", "slice", F.coalesce(earlier, F.lit(0)).alias("from"))
    within = F.sum("copies").over(Window.partitionBy("arc", "slice").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    ranked = groups.withColumn("rank", F.coalesce(within, F.lit(0))).join(cells, ["arc", "slice"]).withColumn("rank", F.col("from") + F.col("rank"))
    end = F.col("rank") + F.col("copies")
    met = ranked.join(F.broadcast(segments), (ranked["arc"] == segments["arc"]) & (F.col("rank") < F.col("hi")) & (end > F.col("lo")))
    met = met.select(*key, "shard", "base", "lo", F.greatest("rank", "lo").alias("a"), F.least(end, F.col("hi")).alias("b"))
    pieces = met.withColumn("a_", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(piece))))
    one_by_one = F.explode(F.sequence(F.col("a_"), F.least(F.col("b"), F.col("a_") + piece) - 1))
    few, many = pieces.where(F.col("b") - F.col("a") <= piece), pieces.where(F.col("b") - F.col("a") > piece)
    dealt = few.unionByName(many.repartition("shard", "a_")).withColumn("rank", one_by_one)
    return dealt.select(
        *key[:1], "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
