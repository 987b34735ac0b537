"""Helpers shared by the training-data operators: the shared folder, written
tables and files that both driver and executors can reach.

Everything that cuts lineage or is exchanged between tasks lives in the folder
named by ``spark.checkpoint.dir``.  Only where that setting is absent and the
master is local (tests on one machine) a private folder is created.  What was
written below the shared folder is deleted when the program ends.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` is a word wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"
#: The six characters that separate such words.
SPACES = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidewater-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean_up)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _clean_up() -> None:
    """Delete what this program wrote, as long as its session is still there."""
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is None:
                return
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the program ends; what is left is only disk space
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write *df* as Parquet in the shared folder and return the table read back.

    The lineage ends at the written files, so a lost executor costs only the
    tasks that were reading them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tw_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    _delete(df.sparkSession, df.tw_path)  # type: ignore[attr-defined]


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file given as URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def session_shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of *text*; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_freed_memory(most: int = 1 << 26) -> None:
    """Let this process use freed arrays of up to *most* bytes again instead of
    mapping new pages for each, where the C library can."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, most), libc.mallopt(-1, most)  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        return


def release_memory() -> None:
    """Give freed pages of this process, Arrow's pool included, back to the
    system, where the C library can: Python workers live on, and executors have
    little room beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return
