"""The engine's operations on one index: search, index, remove, prune, embed."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import chunker, fusion, index, lines, match, vector
from tidewater.plans.store import Store, now_utc
from tidewater.settings import Settings, local_limit
from tidewater.sources.extract import Registry, extract_files
from tidewater.sources.files import scan


#: messages of a report
MESSAGES = 20
Progress = Callable[[str, dict[str, int]], None]


@dataclass
class Report:
    indexed: int = 0
    updated: int = 0
    skipped: int = 0
    removed: int = 0
    scanned: int = 0
    embedded: int = 0
    errors: int = 0
    dry_run: bool = False
    messages: list[str] = field(default_factory=list)
    duration_ms: int = 0


class Engine:
    """An index directory, its settings, and optionally an embedder."""

    def __init__(self, spark: SparkSession, settings: Settings, embedder: vector.Embedder | None = None, progress: Progress = lambda event, counts: None):
        """*progress* is told of each step (scan, files, embed) with its counts."""
        self.progress = progress
        self.spark, self.settings, self.embedder = spark, settings, embedder
        self.store = Store(spark, settings.index_dir)
        self.registry = Registry(settings.text_only, settings.ocr_language if settings.ocr else None)
        if self.embedder is None and settings.embed_backend == "hash":
            self.embedder = vector.HashEmbedder()

    # -- indexing

    def index_paths(self, paths: list[str], force: bool = False) -> Report:
        began, s = time.monotonic(), self.settings
        roots = [s.resolve(p) for p in paths]
        self.progress("scan", {"roots": len(roots)})
        found = scan(self.spark, roots, self.registry.extensions(), s.max_file_bytes).cache()  # one walk
        messages = [r["message"] for r in found.where("message is not null").orderBy("path").limit(MESSAGES).collect()]
        manifest = found.where("message is null").drop("message").dropDuplicates(["path"])
        files, chunks, vectors = (self.store.table(n) for n in ("files", "chunks", "vectors"))
        diff = index.incremental_diff(manifest, files.select("path", "mtime_ns", "size"), force).cache()
        todo = manifest.join(diff.where("status <> 'unchanged'"), "path")

        def load(frames):
            for frame in frames:
                frame["content"] = [open(p, "rb").read() if os.path.exists(p) else b"" for p in frame["path"]]
                yield frame

        loaded = todo.mapInPandas(load, "path string, mtime_ns long, size long, status string, content binary")
        got = extract_files(loaded, "path", "content", s.max_extract_bytes, self.registry, s.extract_timeout).withColumnRenamed("status", "outcome")
        failed = chunker.chunk_errors(got.where("outcome = 'ok'"), "path", "text")
        got = got.join(failed.withColumnRenamed("error", "fault"), "path", "left")
        got = got.withColumn("outcome", F.when(F.col("fault").isNotNull(), "error").otherwise(F.col("outcome"))).withColumn("error", F.coalesce("fault", "error")).drop("fault").cache()
        good = got.where("outcome = 'ok'")
        hashed = todo.join(good, "path").select("path", "mtime_ns", "size", T.content_hash(F.col("text")).alias("content_hash"), F.lit(now_utc()).alias("indexed_at"))
        fresh = chunker.chunk_documents(good, "path", "text", s.chunk_bytes, s.overlap_bytes, s.max_chunks)
        counts = {(r["status"], r["outcome"]): r["n"] for r in diff.join(got.select("path", "outcome"), "path", "left").groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        messages += [f"{r['path']}: {r['error'] or r['outcome']}" for r in got.where("outcome <> 'ok'").orderBy("path").limit(MESSAGES).collect()]
        report = Report(
            indexed=counts.get(("new", "ok"), 0), updated=counts.get(("changed", "ok"), 0),
            skipped=sum(n for (st, _), n in counts.items() if st == "unchanged"),
            errors=sum(n for (_, o), n in counts.items() if o == "error"), messages=messages[:MESSAGES],
        )
        self.progress("files", {"indexed": report.indexed, "updated": report.updated, "skip": report.skipped, "error": report.errors, "empty": sum(n for (_, o), n in counts.items() if o == "empty")})
        if report.indexed + report.updated:
            gone = chunks.join(good.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("chunk_id"))
            tables = {
                "files": index.upsert(files, hashed, "path"),
                "chunks": index.replace_chunks(chunks, fresh.select(chunks.columns), s.max_chunks),
                "vectors": vectors.join(gone, "chunk_id", "left_anti"),
            }
            self.store.commit(tables, {"indexed_at": now_utc()})
            if self.embedder and s.embed_backend != "none":
                report.embedded = self.embed_files().embedded
        found.unpersist(), diff.unpersist(), got.unpersist()
        report.duration_ms = int((time.monotonic() - began) * 1000)
        return report

    def embed_files(self, force: bool = False, paths: list[str] | None = None) -> Report:
        """Vectors for chunks without one, below *paths* only if given, in the order
        of the chunks; *force* makes them anew.  After a change of model all
        vectors go first."""
        if self.embedder is None:
            raise ValueError("no embedder")
        meta = self.store.manifest()["meta"]
        vectors, chunks = self.store.table("vectors"), self.store.table("chunks")
        scope = [c for p in paths or [] for c in self.settings.candidates(p)]
        if paths:
            chunks = chunks.where(index.under_any(F.col("file_path"), scope))
        if meta.get("embed_model", self.embedder.model) != self.embedder.model or (force and not paths):
            vectors = vectors.limit(0)
        elif force:
            vectors = vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
        missing = vector.backfill(chunks, vectors, "id", "chunk_id").sortWithinPartitions("file_path", "chunk_index")
        new = vector.embed_with(missing, "id", "text", self.embedder, self.settings.embed_batch).cache()
        n = new.count()
        self.store.commit({"vectors": vectors.unionByName(new)}, {"embed_model": self.embedder.model})
        new.unpersist()
        self.progress("embed", {"embedded": n})
        return Report(embedded=n)

    def _survivors(self, keep: DataFrame) -> dict[str, DataFrame]:
        chunks = self.store.table("chunks").join(keep.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        chunks = chunks.select(self.store.table("chunks").columns)
        vectors = self.store.table("vectors").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        return {"files": keep, "chunks": chunks, "vectors": vectors}

    def remove_paths(self, paths: list[str]) -> Report:
        """Removes each path or what lies beneath it; what is not indexed is skipped."""
        files, report, targets = self.store.table("files"), Report(), []
        for p in paths:
            touched = [c for c in self.settings.candidates(p) if not files.where(T.under(F.col("path"), c)).isEmpty()]
            if len(touched) > 1:
                report.errors += 1
                report.messages.append(f"{p} is ambiguous")
            elif touched:
                targets.append(touched[0])
            else:
                report.skipped += 1
        if targets:
            keep = index.remove_paths(files, targets)
            report.removed = files.count() - keep.count()
            self.store.commit(self._survivors(keep))
        return report

    def prune(self, dry_run: bool = False, paths: list[str] | None = None) -> Report:
        """Removes what is no longer on disk, below *paths* only if given."""
        files = self.store.table("files")
        scope = [c for p in paths or [] for c in self.settings.candidates(p)]
        within = files.where(index.under_any(F.col("path"), scope)) if scope else files

        def exists(frames):
            for frame in frames:
                yield frame[[os.path.exists(p) for p in frame["path"]]]

        on_disk = within.select("path").mapInPandas(exists, "path string")
        orphans = index.prune_orphans(within, on_disk, self.settings.roots).cache()
        report = Report(scanned=within.count(), removed=orphans.count(), dry_run=dry_run)
        if report.removed and not dry_run:
            self.store.commit(self._survivors(files.join(orphans, "path", "left_anti")))
        orphans.unpersist()
        return report

    # -- reading

    def list_files(self, prefix: str | None = None) -> DataFrame:
        files = self.store.table("files")
        return index.list_prefix(files, prefix) if prefix else files.select("path").orderBy("path")

    def stats(self) -> DataFrame:
        return index.index_stats(self.store.table("files"), self.store.table("vectors"))

    def status(self) -> DataFrame:
        return index.index_status(*(self.store.table(n) for n in ("files", "chunks", "vectors")))

    def search(self, query: str, limit: int = 10, mode: str = "", order: str = "relevance") -> DataFrame:
        """RESULT rows (id, title, path, snippet, score, source) by mode."""
        chunks, vectors = self.store.table("chunks"), self.store.table("vectors")
        if chunks.isEmpty():
            raise ValueError("index is empty")
        mode, limit = mode.strip().lower(), local_limit(limit)
        have = not vectors.isEmpty()
        mode = mode or ("hybrid" if have and self.embedder else "keyword")
        if mode not in ("keyword", "vector", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        model = self.store.manifest()["meta"].get("embed_model")
        usable = have and self.embedder is not None and model == self.embedder.model
        if mode == "vector" and not usable:
            raise ValueError("no vectors" if not have else "vectors are of another model")
        pool = fusion.POOL if mode == "hybrid" else limit
        words = near = None
        if mode != "vector":
            words = match.search_postings(self.store.table("postings"), self.store.table("corpus"), query, pool, order)
        if mode != "keyword" and usable:
            near = vector.top_k(vectors, "chunk_id", "embedding", self.embedder.encode_batch([query])[0], pool).withColumnRenamed("chunk_id", "id")
        if mode == "hybrid":
            legs = [fusion.ranked(words, "id", F.asc("score"))] + ([fusion.ranked(near, "id", F.desc("score"))] if near is not None else [])
            hits = fusion.rrf(legs, limit=limit)
        else:
            hits = words if mode == "keyword" else near
        # the join with the texts keeps no order
        best = F.asc("score") if mode == "keyword" and order == "relevance" else F.desc("score")
        return fusion.hydrate(hits, chunks, "id", "text", F.col("file_path")).orderBy(best, "id")

    def search_file(self, path: str, query: str, limit: int = 10, case_sensitive: bool = False) -> DataFrame:
        """Matching lines of one file, extracted if its format needs it."""
        whole = self.settings.resolve(path)
        with open(whole, "rb") as f:
            status, text, _, error = self.registry.extract(os.path.splitext(whole)[1], f.read())
        if text is None:
            raise ValueError(error or status)
        one = self.spark.createDataFrame([(whole, text)], "path string, text string")
        return lines.line_search(one, "path", "text", query, limit if limit > 0 else 10, case_sensitive, with_text=True)
