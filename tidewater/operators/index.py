"""Index maintenance: walking, change detection, upserts, removal, statistics.

All operators are DataFrame to DataFrame; :mod:`tidewater.plans.store` writes
their results as snapshots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.text import base_name, extension, parent, under

# Directories that a walk does not enter below its root.
SKIP_DIRS = (".git", ".cursor", "node_modules", "vendor", "bin")
MAX_FILE = 2 * 1024 * 1024


def byte_limit(n: int) -> str:
    return f"{n // (1024 * 1024)}MB" if n and n % (1024 * 1024) == 0 else f"{n} bytes"


def under_any(path: Column, roots: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [under(path, r) for r in roots], F.lit(False))


def relative(path: Column, root: str) -> Column:
    return F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))


def in_skipped_dir(path: Column, root: str) -> Column:
    """A directory between the root and the file has a skipped name."""
    parts = F.split(relative(path, root), "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*SKIP_DIRS))


def walk_filter(files: DataFrame, root: str, extensions: list[str], max_size: int = MAX_FILE) -> DataFrame:
    """path, size, status: ``ok``, or ``too large`` for files over the cap;
    other extensions and skipped directories are left out."""
    path = F.col("path")
    kept = files.where(under(path, root) & extension(path).isin(*extensions) & ~in_skipped_dir(path, root))
    return kept.select("path", "size", F.when(F.col("size") > max_size, f"larger than {byte_limit(max_size)}").otherwise("ok").alias("status"))


def incremental_diff(manifest: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """path, status: ``new``, ``changed`` or ``unchanged`` by (mtime_ns, size)."""
    old = files.select("path", F.col("mtime_ns").alias("m_"), F.col("size").alias("s_"))
    both = manifest.join(old, "path", "left")
    same = F.col("mtime_ns").eqNullSafe(F.col("m_")) & F.col("size").eqNullSafe(F.col("s_"))
    status = F.when(F.col("m_").isNull(), "new").when(same & F.lit(not force), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of *new* replace those of *old* with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return versions.withColumn("place", place).where("place = 1").drop("place")


def replace_chunks(chunks: DataFrame, new: DataFrame, cap: int = 64) -> DataFrame:
    """Chunks of re-indexed files go, new ones up to the cap come."""
    kept = chunks.join(new.select("file_path").distinct(), "file_path", "left_anti")
    return kept.unionByName(new.where(F.col("chunk_index") < cap))


def remove_paths(files: DataFrame, paths: list[str]) -> DataFrame:
    """What stays after removing each path or everything beneath it."""
    return files.where(~under_any(F.col("path"), paths))


def prune_orphans(files: DataFrame, manifest: DataFrame, roots: list[str]) -> DataFrame:
    """path, reason: outside all roots, or missing on disk."""
    gone = files.join(manifest.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("reason"))
    outside = files.where(~under_any(F.col("path"), roots)).select("path", F.lit("outside").alias("reason"))
    return outside.unionByName(gone.where(under_any(F.col("path"), roots)))


def list_prefix(files: DataFrame, prefix: str, ascii_ci: bool = False) -> DataFrame:
    return files.where(under(F.col("path"), prefix, ascii_ci)).select("path").orderBy("path")


def folder_counts(files: DataFrame) -> DataFrame:
    folder = parent(F.col("path"))
    return files.select(folder.alias("folder")).where("folder <> '' and folder <> '.'").groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def index_stats(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: file, folder and vector counts, bytes, last change."""
    folder = parent(F.col("path"))
    of_files = files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.countDistinct(F.when((folder != "") & (folder != "."), folder)).alias("folder_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.max("indexed_at").alias("last_index_change"),
    )
    return of_files.join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("vector_chunk_count"))))


def index_status(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts, vector readiness and a message."""
    counts = files.agg(F.count(F.lit(1)).alias("file_count")).join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunk_count"))))
    counts = counts.join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("vector_count"))))
    ready = (F.col("chunk_count") > 0) & (F.col("vector_count") == F.col("chunk_count"))
    message = F.when(F.col("chunk_count") == 0, "index is empty").when(ready, "ready").otherwise("vectors incomplete")
    return counts.select("*", ready.alias("vector_ready"), message.alias("message"))


def index_report(outcomes: DataFrame, cap: int = 20) -> DataFrame:
    """One row of counters from (path, status); at most *cap* error messages."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("path"))
    bad = outcomes.where("status = 'error'").orderBy("path").limit(cap).withColumn("place", place)
    messages = bad.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), ",").alias("messages"))
    counts = outcomes.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("new", "indexed"), ("changed", "updated"), ("unchanged", "skipped"), ("error", "errors"))])
    return counts.join(F.broadcast(messages))
