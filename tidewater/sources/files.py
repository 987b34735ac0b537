"""Directory scans: metadata first, content only for what has changed."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.index import MAX_FILE, SKIP_DIRS, byte_limit

FOUND = "path string, mtime_ns long, size long, message string"
#: folders that the driver opens before tasks walk the rest, rows of an Arrow batch
FAN_OUT, BATCH = 256, 10_000


def _open_folders(roots: list[str], fan_out: int) -> list[tuple[str, bool]]:
    """(folder, whether all beneath it belongs to it), breadth first.  Only names
    of folders are kept, no more than *fan_out* and one folder's subfolders."""
    opened, waiting = [], deque(roots)
    while waiting and len(opened) + len(waiting) < fan_out:
        folder = waiting.popleft()
        opened.append((folder, False))
        try:
            with os.scandir(folder) as entries:
                waiting.extend(sorted(e.path for e in entries if e.name not in SKIP_DIRS and e.is_dir(follow_symlinks=False)))
        except OSError:
            pass  # the walk of this folder reports it
    return opened + [(folder, True) for folder in waiting]


def _look(path: str, max_size: int) -> tuple[str, int, int, str | None]:
    shown = os.fsencode(path).decode("utf-8", "replace")
    if shown != path:
        return shown, 0, 0, f"{shown}: name is not UTF-8"
    try:
        st = os.stat(path)
    except OSError as e:
        return path, 0, 0, f"{path}: {e.strerror}"
    if st.st_size > max_size:
        return path, 0, 0, f"{path}: larger than {byte_limit(max_size)}"
    return path, st.st_mtime_ns, st.st_size, None


def _walk(folder: str, deep: bool, wanted: set[str], max_size: int) -> Iterator[tuple[str, int, int, str | None]]:
    failed: list[OSError] = []
    for at, dirs, names in os.walk(folder, onerror=failed.append):
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS) if deep else []
        yield from (_look(os.path.join(at, n), max_size) for n in sorted(names) if os.path.splitext(n)[1].lower() in wanted)
    yield from ((os.fsencode(e.filename).decode("utf-8", "replace"), 0, 0, f"{e.strerror}: {e.filename!r}") for e in failed)


def scan(spark: SparkSession, roots: list[str], extensions: list[str], max_size: int = MAX_FILE, fan_out: int = FAN_OUT) -> DataFrame:
    """path, mtime_ns, size of the indexable files, or a message of what is not.

    The driver opens folders until there are enough of them, tasks list the files,
    so no list of files gathers in one place.  Skipped directories are pruned while
    walking, symbolic links to directories are not followed; a root is walked
    whatever its name.  Roots within each other give rows more than once."""
    wanted = {e.lower() for e in extensions}
    alone = [os.path.abspath(r) for r in roots if os.path.isfile(r)]
    rows = [_look(p, max_size) for p in alone if os.path.splitext(p)[1].lower() in wanted]
    rows += [(r, 0, 0, f"{r}: not found") for r in roots if not os.path.exists(r)]
    folders = _open_folders([os.path.abspath(r) for r in roots if os.path.isdir(r)], fan_out)
    found = spark.createDataFrame(rows, FOUND)
    if not folders:
        return found

    def walk(frames):
        for frame in frames:
            for folder, deep in zip(frame["folder"], frame["deep"], strict=True):
                for some in batched(_walk(os.fsdecode(folder), deep, wanted, max_size), BATCH):
                    yield pd.DataFrame(some, columns=["path", "mtime_ns", "size", "message"])

    tasks = min(len(folders), max(fan_out, 1))
    # names of folders need not be UTF-8
    todo = spark.createDataFrame([(os.fsencode(f), deep) for f, deep in folders], "folder binary, deep boolean").repartition(tasks)
    return found.unionByName(todo.mapInPandas(walk, FOUND))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, content below a root of any file system Spark reads."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
