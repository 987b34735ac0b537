"""The engine's operations under their public names, as plain dictionaries.

Each takes plain values and returns an envelope with the results and
``duration_ms``; errors of a caller are ``ValueError`` and its kin.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from tidewater.service import Engine
from tidewater.settings import local_limit
from tidewater.sources.web import WebClient, http_transport


def _ms(began: float) -> int:
    return int((time.monotonic() - began) * 1000)


class Session:
    def __init__(self, engine: Engine, web: WebClient | None = None, reranker=None):
        """*reranker*: a function (query, snippets) -> [(index, score)], whose
        results are ordered by score; without it *web* reranks, in its own order."""
        self.engine, self.web, self.reranker = engine, web, reranker

    @classmethod
    def open(cls, engine: Engine) -> Session:
        """With web search and reranking where the settings name a service."""
        s = engine.settings
        web = WebClient(http_transport(s.web_url, s.web_key)) if s.web_url and s.web_key else None
        return cls(engine, web)

    def search_local(self, query: str, limit: int = 10, mode: str = "", rerank: bool = False) -> dict:
        """Indexed chunks for a query by keyword, vector or hybrid search, with timing."""
        began = time.monotonic()
        if not query.strip():
            raise ValueError("query is empty")
        if rerank and self.reranker is None and self.web is None:
            raise ValueError("reranking needs a web search API key")
        rows = [r.asDict() for r in self.engine.search(query, local_limit(limit), mode).collect()]
        timing = {"search_ms": _ms(began)}
        if rerank and rows:
            start = time.monotonic()
            # one page of results, so the driver does it
            texts = [r["snippet"] for r in rows]
            if self.reranker is not None:
                scores = sorted(self.reranker(query, texts), key=lambda s: (-s[1], s[0]))
            else:
                scores = self.web.rerank(query, texts, len(texts))
            rows = [rows[i] | {"score": float(x)} for i, x in scores if 0 <= i < len(rows)]
            timing["rerank_ms"] = _ms(start)
        return {"count": len(rows), "results": rows, "duration_ms": _ms(began), "timing": timing}

    def search_file(self, path: str, query: str, limit: int = 10, case_sensitive: bool = False) -> dict:
        """Lines of one file that hold terms of a query, best first."""
        began = time.monotonic()
        rows = [r.asDict() for r in self.engine.search_file(path, query, limit, case_sensitive).collect()]
        whole = self.engine.settings.resolve(path)
        name = whole.rsplit("/", 1)[-1]
        out = [{"id": f"{whole}:{r['line']}", "title": f"{name}:{r['line']}", "path": whole, "snippet": r["text"], "score": float(r["score"]), "source": "file", "line": r["line"]} for r in rows]
        return {"count": len(out), "results": out, "duration_ms": _ms(began)}

    def search_web(self, query: str, limit: int = 10, freshness: str = "noLimit", summary: bool = True) -> dict:
        """Pages of the web search service for a query."""
        began = time.monotonic()
        if self.web is None:
            raise ValueError("web search API key is not set")
        answer = json.loads(self.web.search(query, limit, freshness, summary))
        if answer.get("code", 200) != 200:
            raise RuntimeError(f"web search failed: {answer.get('msg') or answer['code']}")
        found = ((answer.get("data") or {}).get("webPages") or {}).get("value") or []
        rows = [{"id": r.get("id") or r.get("url"), "title": r.get("name"), "url": r.get("url"), "snippet": r.get("summary") or r.get("snippet"), "source": "web"} for r in found]
        return {"count": len(rows), "results": rows, "duration_ms": _ms(began)}

    def _report(self, report, *fields: str) -> dict:
        every = asdict(report)
        return {k: every[k] for k in fields}

    def index_paths(self, paths: list[str], force: bool = False) -> dict:
        """Index new and changed files below the paths; all of them with force."""
        began = time.monotonic()
        if not paths:
            raise ValueError("paths are required")
        return self._report(self.engine.index_paths(paths, force), "indexed", "updated", "skipped", "errors", "messages") | {"duration_ms": _ms(began)}

    def remove_paths(self, paths: list[str]) -> dict:
        """Take files or folders out of the index."""
        began = time.monotonic()
        if not paths:
            raise ValueError("paths are required")
        return self._report(self.engine.remove_paths(paths), "removed", "skipped", "errors", "messages") | {"duration_ms": _ms(began)}

    def index_prune(self, paths: list[str] | None = None, dry_run: bool = False) -> dict:
        """Take out what is no longer on disk, below the paths if given."""
        began = time.monotonic()
        return self._report(self.engine.prune(dry_run, paths), "scanned", "removed", "skipped", "errors", "dry_run", "messages") | {"duration_ms": _ms(began)}

    def index_status(self) -> dict:
        """Counts of files, chunks and vectors, and whether vectors are ready."""
        status = self.engine.status().first().asDict()
        return status | ({} if self.web is not None else {"message": "web search API key is not set"})

    def list_indexed_files(self, prefix: str | None = None) -> dict:
        """Paths in the index, below a prefix if given."""
        began = time.monotonic()
        paths = [r["path"] for r in self.engine.list_files(prefix).select("path").collect()]
        return {"count": len(paths), "paths": paths, "duration_ms": _ms(began)}

    def index_stats(self) -> dict:
        """Counts of files and folders, bytes, last change."""
        began = time.monotonic()
        return self.engine.stats().first().asDict() | {"duration_ms": _ms(began)}

    #: operation by name, for transports
    OPERATIONS = ("search_file", "search_local", "search_web", "index_paths", "remove_paths", "index_prune", "index_status", "list_indexed_files", "index_stats")

    def call(self, name: str, arguments: dict) -> dict:
        if name not in self.OPERATIONS:
            raise ValueError(f"unknown operation {name!r}")
        return getattr(self, name)(**arguments)


