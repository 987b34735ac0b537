"""Command line: python -m tidewater index|embed|extract|remove|prune|search|list|stats|status|serve|stdio|watch ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tidewater.service import Engine
from tidewater.server import Server
from tidewater.session import Session
from tidewater.settings import Settings
from tidewater.sources.extract import Registry
from tidewater.stdio import serve_stdio
from tidewater.streaming.watcher import Watcher


def extract(path: str) -> int:
    """Print the text of one file; 1 if there is none."""
    with open(path, "rb") as f:
        status, text, warn, error = Registry().extract_within(os.path.splitext(path)[1], f.read(), 30.0)
    for line in [*warn, *([error or status] if status != "ok" else [])]:
        print(line, file=sys.stderr)
    if status == "ok":
        print(text)
    return int(status != "ok")


def show(event: str, counts: dict[str, int]) -> None:
    print(event, *(f"{k}={n}" for k, n in counts.items()), file=sys.stderr)


def follow(engine: Engine, checkpoint: str) -> int:
    """Keep the index up to date with the watch paths until interrupted."""
    watcher = Watcher(engine, lambda report: print(report, file=sys.stderr))
    query = watcher.start(checkpoint)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        pass
    finally:
        watcher.stop()
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "remove"):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="+")
        s.add_argument("--force", action="store_true")
    s = sub.add_parser("prune")
    s.add_argument("paths", nargs="*")
    s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("embed")
    s.add_argument("paths", nargs="*")
    s.add_argument("--force", action="store_true")
    sub.add_parser("extract").add_argument("path")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8787)
    s.add_argument("--token")
    sub.add_parser("stdio")
    sub.add_parser("watch").add_argument("--checkpoint", required=True, help="folder of the stream's state")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--mode", default="")
    sub.add_parser("list").add_argument("--prefix")
    sub.add_parser("stats")
    sub.add_parser("status")
    a = p.parse_args(argv)
    if a.command == "extract":
        return extract(a.path)
    engine = Engine(SparkSession.builder.appName("tidewater").config("spark.ui.showConsoleProgress", "false").getOrCreate(), Settings.from_env(), progress=show)
    if a.command == "serve":
        with Server((a.host, a.port), Session.open(engine), a.token) as server:
            server.serve_forever()
        return 0
    if a.command == "stdio":
        serve_stdio(Session.open(engine), sys.stdin, sys.stdout)
        return 0
    if a.command == "watch":
        return follow(engine, a.checkpoint)
    if a.command in ("index", "remove", "prune", "embed"):
        report = {"index": lambda: engine.index_paths(a.paths, a.force), "remove": lambda: engine.remove_paths(a.paths), "prune": lambda: engine.prune(a.dry_run, a.paths), "embed": lambda: engine.embed_files(a.force, a.paths)}[a.command]()
        print(report)
        return int(report.errors > 0)
    rows = {"search": lambda: engine.search(a.query, a.limit, a.mode), "list": lambda: engine.list_files(a.prefix), "stats": engine.stats, "status": engine.status}[a.command]()
    for row in rows.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
