"""File events as a streaming source: ``spark.readStream.format("file_events")``.

Folders are compared with what they held at the last poll, so new folders need
no subscription.  Every poll ends with a ``tick``, a row without a path, which
lets event time pass while nothing happens.  The first poll is the baseline.
What was seen is held by the reader: after a restart the baseline is taken anew,
and a rescan of the index finds what happened in between.
"""

from __future__ import annotations

import datetime
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidewater.operators.index import SKIP_DIRS

SCHEMA = "ts timestamp, path string, kind string"


def snapshot(paths: list[str]) -> dict[str, tuple[int, int]]:
    """(mtime_ns, size) of every file in or below *paths*; symbolic links are not followed."""
    found: dict[str, tuple[int, int]] = {}

    def note(path: str) -> None:
        try:
            st = os.lstat(path)
        except OSError:
            return  # gone between the listing and now: not there
        found[path] = st.st_mtime_ns, st.st_size

    for root in paths:
        if os.path.isfile(root):
            note(root)
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d not in SKIP_DIRS]
            for name in names:
                note(os.path.join(folder, name))
    return found


def changes(before: dict, after: dict) -> list[tuple[str, str]]:
    """(path, kind) in path order: create, write or remove."""
    out = [(p, "create" if p not in before else "write") for p, v in after.items() if before.get(p) != v]
    return sorted(out + [(p, "remove") for p in before if p not in after])


class FileEventReader(SimpleDataSourceStreamReader):
    def __init__(self, paths: list[str]):
        self.paths, self.seen, self.held = paths, None, {}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = snapshot(self.paths)
        at = max(start["at"] + 1, time.time_ns() // 1000)
        ts = datetime.datetime.fromtimestamp(at / 1e6, datetime.UTC)
        rows = [(ts, path, kind) for path, kind in changes(now if self.seen is None else self.seen, now)] + [(ts, None, "tick")]
        self.seen, self.held[start["at"], at] = now, rows
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.held.get((start["at"], end["at"]), []))

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if k[1] > end["at"]}


class FileEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> FileEventReader:
        return FileEventReader(json.loads(self.options["paths"]))


def file_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ts, path, kind of what happens to the files in or below *paths*."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("paths", json.dumps(paths)).load()
