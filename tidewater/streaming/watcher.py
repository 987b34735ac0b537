"""Keeps an index up to date with its watch paths."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.service import Engine, Report
from tidewater.streaming import watch
from tidewater.streaming.source import file_events

#: paths handed to the engine at once
SLICE = 1000


class Watcher:
    """File events, debounced for each path, become index and remove operations.

    Every *watch_rescan* seconds (0: never) the watch paths are indexed again,
    which costs a listing where nothing has changed.  At the end, whatever is
    still pending is found by comparing the index with the disk."""

    def __init__(self, engine: Engine, report: Callable[[Report], None] = lambda r: None):
        self.engine, self.report, self.lock, self.query = engine, report, threading.Lock(), None
        self.stopping = False
        self.paths, self.rescanned = engine.settings.watch_paths, time.monotonic()
        if not self.paths:
            raise ValueError("no watch paths")

    def start(self, checkpoint: str) -> StreamingQuery:
        gap = f"{max(1, round(self.engine.settings.watch_debounce * 1000))} milliseconds"
        known = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*self.engine.registry.extensions())
        events = file_events(self.engine.spark, self.paths).withWatermark("ts", "0 seconds")
        bursts = watch.debounce(watch.watch_ops(events, "ts", "path", "kind", known), gap)
        writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.fire)
        self.query = writer.trigger(processingTime=gap).start()
        self.settle()
        return self.query

    def fire(self, bursts: DataFrame, batch: int) -> None:
        with self.lock:
            if self.stopping:
                return
            bursts = bursts.persist()  # the state is computed once
            for op in ("remove", "index"):
                rows = (r["path"] for r in bursts.where(F.col("op") == op).select("path").distinct().toLocalIterator())
                while paths := list(islice(rows, SLICE)):
                    self._apply(op, paths)
            bursts.unpersist()
        if 0 < self.engine.settings.watch_rescan <= time.monotonic() - self.rescanned:
            self.rescan()

    def _apply(self, op: str, paths: list[str]) -> None:
        if op == "remove":
            self.report(self.engine.remove_paths(paths))
        elif there := [p for p in paths if os.path.isfile(p)]:
            self.report(self.engine.index_paths(there))

    def rescan(self) -> None:
        with self.lock:
            self.report(self.engine.index_paths([p for p in self.paths if os.path.exists(p)]))
            self.rescanned = time.monotonic()

    def stop(self) -> None:
        """End the stream; pending events are applied, as the disk shows them."""
        with self.lock:  # operations that run are finished
            self.stopping = True
        if self.query is not None:
            self.query.stop()
        self.settle()

    def settle(self) -> None:
        """Make the index agree with the disk, removals included."""
        self.rescan()
        with self.lock:
            self.report(self.engine.prune(paths=self.paths))
