"""Versioned Parquet snapshots of an index with an atomic pointer.

A commit writes the tables that change to a new version, then replaces the
manifest in one rename; it names the version of each table, so what has not
changed stays where it is.  The lock file admits one writer.  Tables that neither
the new manifest nor the one before it names are dropped after the rename.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import match

SCHEMA_VERSION = 3
SCHEMAS = {
    "files": "path string, mtime_ns long, size long, content_hash string, indexed_at string",
    "chunks": "id string, file_path string, chunk_index int, line_start int, line_end int, text string",
    "vectors": "chunk_id string, embedding array<float>",
}
#: Made from the chunks at every commit of them.
DERIVED = {
    "postings": "term string, id string, positions array<int>, dl int, bucket int",
    "corpus": "n_docs long, n_tokens long",
}


def now_utc() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Store:
    """An index directory on a file system with atomic renames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def manifest(self) -> dict:
        path = os.path.join(self.root, "manifest.json")
        if not os.path.exists(path):
            return {"schema_version": SCHEMA_VERSION, "version": 0, "meta": {}, "tables": {}}
        with open(path, encoding="utf-8") as f:
            return self.migrate(json.load(f))

    @staticmethod
    def migrate(manifest: dict) -> dict:
        """Manifests of version 0 have no meta, those of version 1 no vectors;
        below version 3 all tables are of one version."""
        version = manifest.get("schema_version", 0)
        if version > SCHEMA_VERSION:
            raise ValueError(f"index of schema version {version}")
        manifest.setdefault("meta", {})
        manifest.setdefault("tables", dict.fromkeys(SCHEMAS | DERIVED, manifest.get("version", 0)))
        manifest["schema_version"] = SCHEMA_VERSION
        return manifest

    def _folder(self, version: int, name: str) -> str:
        return os.path.join(self.root, f"v={version}", name)

    def table(self, name: str) -> DataFrame:
        version = self.manifest()["tables"].get(name, 0)
        path = self._folder(version, name)
        if version == 0 or not os.path.isdir(path):
            return self.spark.createDataFrame([], (SCHEMAS | DERIVED)[name])
        return self.spark.read.schema((SCHEMAS | DERIVED)[name]).parquet(path)

    @contextmanager
    def writer(self):
        lock = os.path.join(self.root, "lock")
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        try:
            yield
        finally:
            os.close(handle)
            os.unlink(lock)

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> int:
        """Write *tables* as a new version; the others stay as they are."""
        with self.writer():
            old = self.manifest()
            version = old["version"] + 1
            written = dict.fromkeys(tables, version)
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(self._folder(version, name))
            if "chunks" in tables:
                self._derive(version)
                written |= dict.fromkeys(DERIVED, version)
            new = old | {"version": version, "meta": old["meta"] | (meta or {}), "tables": old["tables"] | written}
            temporary = os.path.join(self.root, "manifest.json.new")
            with open(temporary, "w", encoding="utf-8") as f:
                json.dump(new, f)
            os.replace(temporary, os.path.join(self.root, "manifest.json"))
            self._drop_unnamed(old["tables"], new["tables"])
            return version

    def _derive(self, version: int) -> None:
        """Postings and corpus size of the chunks just written."""
        chunks = self.spark.read.schema(SCHEMAS["chunks"]).parquet(self._folder(version, "chunks"))
        terms = match.index_postings(chunks, "id", "text")
        terms = terms.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term")
        terms.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(version, "postings"))
        match.corpus_size(chunks, "text").write.mode("overwrite").parquet(self._folder(version, "corpus"))

    def _drop_unnamed(self, *named: dict[str, int]) -> None:
        keep = {self._folder(version, name) for tables in named for name, version in tables.items()}
        for folder in glob.glob(os.path.join(glob.escape(self.root), "v=*")):
            for table in glob.glob(os.path.join(glob.escape(folder), "*")):
                if table not in keep:
                    shutil.rmtree(table, ignore_errors=True)
            if not os.listdir(folder):
                os.rmdir(folder)
