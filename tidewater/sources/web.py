"""Web search results: a client with cache and backoff, and the JSON decoder."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRESHNESS = ("noLimit", "oneDay", "oneWeek", "oneMonth", "oneYear")
TTL, ENTRIES, RETRIES = 15 * 60, 128, 3

RESPONSE = "code int, msg string, data struct<webPages: struct<value: array<struct<id: string, name: string, url: string, snippet: string, summary: string>>>>"

#: (path, body) -> (status, body)
Transport = Callable[[str, bytes], tuple[int, bytes]]


def http_transport(url: str, key: str, timeout: float = 30.0) -> Transport:
    """Posts JSON below *url* with *key* as bearer; an HTTP error is an answer."""
    if not url.startswith(("https://", "http://")):
        raise ValueError(f"not an HTTP address: {url!r}")

    def post(path: str, body: bytes) -> tuple[int, bytes]:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        try:
            with urllib.request.urlopen(urllib.request.Request(url.rstrip("/") + path, body, head), timeout=timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    return post


def decode(responses: DataFrame, json_col: str, key_col: str) -> DataFrame:
    """key, id, title, url, snippet, score, source; responses with another code
    than 0 or 200 have no rows here (see :func:`failures`)."""
    parsed = responses.select(key_col, F.from_json(json_col, RESPONSE).alias("r")).where(F.coalesce("r.code", F.lit(0)).isin(0, 200))
    rows = parsed.select(key_col, F.posexplode("r.data.webPages.value").alias("i", "p"))

    def first_of(a: str, b: str):
        return F.coalesce(F.nullif(F.trim(F.col(a)), F.lit("")), F.col(b))

    return rows.select(
        key_col, first_of("p.id", "p.url").alias("id"), F.col("p.name").alias("title"), F.col("p.url").alias("url"),
        first_of("p.summary", "p.snippet").alias("snippet"), F.round(1.0 / (F.col("i") + 1), 6).alias("score"), F.lit("web").alias("source"),
    )


def failures(responses: DataFrame, json_col: str, key_col: str) -> DataFrame:
    parsed = responses.select(key_col, F.from_json(json_col, RESPONSE).alias("r"))
    return parsed.where(~F.coalesce("r.code", F.lit(0)).isin(0, 200)).select(key_col, "r.code", "r.msg")


class Cache:
    """Values for a limited time; the oldest of too many goes first."""

    def __init__(self, ttl: float = TTL, entries: int = ENTRIES, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.entries, self.clock, self.held = ttl, entries, clock, OrderedDict()

    def get(self, key: str) -> bytes | None:
        found = self.held.get(key)
        if found and found[1] <= self.clock():
            del self.held[key]
            return None
        return bytes(found[0]) if found else None

    def put(self, key: str, value: bytes) -> None:
        self.held.pop(key, None)
        while len(self.held) >= self.entries:
            self.held.popitem(last=False)
        self.held[key] = (bytes(value), self.clock() + self.ttl)


class WebClient:
    """Search and rerank over an injected transport."""

    def __init__(self, transport: Transport, sleep: Callable[[float], None] = time.sleep, cache: Cache | None = None):
        self.transport, self.sleep, self.cache = transport, sleep, cache or Cache()

    def _post(self, path: str, body: dict) -> bytes:
        for attempt in range(RETRIES + 1):
            status, raw = self.transport(path, json.dumps(body).encode())
            if status == 429 and attempt < RETRIES:
                self.sleep(0.2 * 2**attempt + random.uniform(0, 0.1))
                continue
            if status != 200:
                raise RuntimeError(f"HTTP {status}: {raw[:200].decode('utf-8', 'replace')}")
            return raw
        raise AssertionError

    def search(self, query: str, limit: int = 10, freshness: str = "noLimit", summary: bool = True) -> bytes:
        if not query.strip():
            raise ValueError("empty query")
        if freshness not in FRESHNESS:
            raise ValueError(f"unknown freshness {freshness!r}")
        count = min(10, limit) if limit > 0 else 10
        key = f"{query}|{freshness}|{summary}|{count}"
        if (raw := self.cache.get(key)) is None:
            raw = self._post("/v1/web-search", {"query": query, "freshness": freshness, "summary": summary, "count": count})
            self.cache.put(key, raw)
        return raw

    def rerank(self, query: str, documents: list[str], top_n: int, model: str = "langsearch-reranker-v1") -> list[tuple[int, float]]:
        """(index, score) in the service's order; positions outside the list are dropped."""
        top_n = min(top_n, len(documents)) if top_n > 0 else len(documents)
        raw = self._post("/v1/rerank", {"model": model, "query": query, "documents": documents, "top_n": top_n})
        found = json.loads(raw).get("results", [])
        return [(r["index"], r["relevance_score"]) for r in found if 0 <= r["index"] < len(documents)]
