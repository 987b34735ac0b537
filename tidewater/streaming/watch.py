"""File events: classification and per-path debounce, on batches and streams.

Event time replaces timers: a burst of events of one path is a session that
ends when nothing follows within the gap, and a removal in it dominates.  On a
stream the watermark decides when a session is final; later events are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def classify(kind: Column, indexable: Column) -> Column:
    """``index``, ``remove`` or null for what does not matter."""
    return F.when(kind.isin("remove", "rename"), "remove").when(kind.isin("create", "write") & indexable, "index")


def watch_ops(events: DataFrame, ts: str, path: str, kind: str, indexable: Column | None = None) -> DataFrame:
    """ts, path, op of the events that matter; those without a time do not."""
    op = classify(F.col(kind), F.lit(True) if indexable is None else indexable)
    # the condition needs the time, so it is not moved below a watermark, which
    # rows without an operation shall advance
    op = F.when(F.col(ts).isNotNull(), op)
    return events.select(F.col(ts).alias("ts"), F.col(path).alias("path"), op.alias("op")).where("op is not null")


def debounce(ops: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """path, op, fired_at, n_events: one row for each burst."""
    source = ops.withWatermark("ts", watermark) if watermark else ops
    burst = source.groupBy("path", F.session_window("ts", gap).alias("w"))
    out = burst.agg(F.max((F.col("op") == "remove").cast("int")).alias("removed"), F.count(F.lit(1)).alias("n_events"))
    return out.select("path", F.when(F.col("removed") == 1, "remove").otherwise("index").alias("op"), F.col("w.end").alias("fired_at"), "n_events")


def run(ops: DataFrame, gap: str, watermark: str, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Feed finished bursts to *apply*, batch by batch."""
    writer = debounce(ops, gap, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=gap)).start()
