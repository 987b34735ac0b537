"""The session's operations, the HTTP adapter, postings, and mended rules."""

import io
import json
import os
import threading
import time
import urllib.error
import urllib.request

import pytest

from tidewater.functions import text as T
from tidewater.operators import chunker, match
from tidewater.plans.store import SCHEMAS, Store
from tidewater.server import Server
from tidewater.service import Engine
from tidewater.session import Session
from tidewater.settings import Settings
from tidewater.sources.extract import Extracted, Registry
from tidewater.sources.files import scan
from tidewater.stdio import serve_stdio


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root, index = tmp_path_factory.mktemp("root"), tmp_path_factory.mktemp("index")
    (root / "a.md").write_text("# Realms\n\nThe shard realm partitions all realms.\n")
    (root / "sub").mkdir()
    (root / "sub" / "b.md").write_text("Another text about sharding.\nalpha beta alpha\n")
    (root / "long.txt").write_text("x" * ((1 << 20) + 5))
    env = {"TIDEWATER_ROOTS": str(root), "TIDEWATER_INDEX_DIR": str(index), "TIDEWATER_EMBED_BACKEND": "hash", "TIDEWATER_MAX_EXTRACT_BYTES": "2000000"}
    engine = Engine(spark, Settings.from_env(env))
    made = Session(engine, reranker=lambda query, snippets: [(i, float(i)) for i in range(len(snippets))])
    report = made.index_paths([str(root)])
    assert (report["indexed"], report["errors"]) == (2, 1) and "line too long" in report["messages"][0]
    made.root = root
    return made


def test_operations(session):
    found = session.search_local("shard realm", mode="keyword")
    assert found["count"] == 1 and found["results"][0]["path"].endswith("a.md") and {"duration_ms", "timing"} <= set(found)
    both = session.search_local("sharding", mode="hybrid", rerank=True)
    assert both["count"] == 2 and [r["score"] for r in both["results"]] == [1.0, 0.0] and "rerank_ms" in both["timing"]
    hit = session.search_file(str(session.root / "sub" / "b.md"), "alpha")["results"][0]
    assert (hit["line"], hit["title"], hit["snippet"], hit["source"]) == (2, "b.md:2", "alpha beta alpha", "file")
    assert session.list_indexed_files()["count"] == 2 and session.index_stats()["folder_count"] == 2
    assert session.index_status()["file_count"] == 2
    assert session.index_prune([str(session.root / "sub")], dry_run=True)["scanned"] == 1
    for name, arguments in (("search_web", {"query": "x"}), ("index_paths", {"paths": []}), ("other", {}), ("search_local", {"query": " "})):
        with pytest.raises(ValueError):
            session.call(name, arguments)


def test_http(session):
    with Server(("127.0.0.1", 0), session, "secret") as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def ask(method, path, body=None, token="secret"):
            request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}"}, method=method)
            try:
                with urllib.request.urlopen(request, timeout=120) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        assert ask("GET", "/healthz", token="no") == (200, {"status": "ok"})
        assert ask("GET", "/v1/stats", token="no")[0] == 401 and ask("GET", "/v1/search")[0] == 405 and ask("GET", "/other")[0] == 404
        assert ask("POST", "/v1/search", {"query": "shard realm", "mode": "keyword"})[1]["count"] == 1
        assert ask("POST", "/v1/search", {"query": "x", "mode": "odd"})[0] == 400
        assert ask("GET", "/v1/files?prefix=" + str(session.root / "sub"))[1]["count"] == 1 and ask("GET", "/v1/stats")[1]["file_count"] == 2
        server.shutdown()


def test_stdio(session):
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "list_indexed_files", "arguments": {}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search_local", "arguments": {"query": " "}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "close"}},
        {"jsonrpc": "2.0", "id": 6, "method": "other"},
        {"id": 7},
    ]
    out = io.StringIO()
    serve_stdio(session, io.StringIO("\n".join(map(json.dumps, asked)) + "\n\nnot json\n"), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, None, None]
    assert [r["error"]["code"] for r in got[4:]] == [-32602, -32601, -32600, -32700]
    tools = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert list(tools) == list(Session.OPERATIONS) and tools["index_paths"]["required"] == ["paths"]
    assert tools["index_prune"]["properties"] == {"paths": {"type": "array", "items": {"type": "string"}}, "dry_run": {"type": "boolean"}}
    listed = got[2]["result"]
    assert listed["structuredContent"]["count"] == 2 and json.loads(listed["content"][0]["text"]) == listed["structuredContent"]
    assert got[3]["result"]["isError"]


def test_scan_lists_in_tasks(spark, tmp_path):
    for name in ("a/b/c", "a/d", "e", ".git", "a/vendor"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "f.md").write_text(name)
    (tmp_path / "big.md").write_text("x" * 50)
    (tmp_path / "other.bin").write_text("x")
    (tmp_path / "loop").symlink_to(tmp_path)
    with open(os.fsencode(tmp_path) + b"/e/\xff.md", "w"):
        pass
    roots = [str(tmp_path), str(tmp_path / "big.md"), str(tmp_path / "none")]
    for fan_out in (1, 2, 4, 99):  # wherever the driver leaves off
        rows = scan(spark, roots, [".md"], 20, fan_out).collect()
        assert sorted(r["path"][len(str(tmp_path)) :] for r in rows if r["message"] is None) == ["/a/b/c/f.md", "/a/d/f.md", "/e/f.md"]
        assert all(r["mtime_ns"] == os.stat(r["path"]).st_mtime_ns for r in rows if r["message"] is None)
        assert sorted(r["message"].rsplit(": ")[-1] for r in rows if r["message"]) == ["larger than 20 bytes"] * 2 + ["name is not UTF-8", "not found"]


def test_commits_leave_other_tables_where_they_are(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    chunks = spark.createDataFrame([("c", "/f", 0, 1, 1, "some words")], SCHEMAS["chunks"])
    store.commit({"chunks": chunks})
    for _ in range(3):
        store.commit({"vectors": spark.createDataFrame([("c", [1.0])], SCHEMAS["vectors"])})
    assert store.manifest()["tables"] == {"chunks": 1, "postings": 1, "corpus": 1, "vectors": 4}
    assert store.table("postings").count() == 2 and store.table("vectors").count() == 1 and store.table("files").count() == 0
    assert sorted(os.listdir(tmp_path / "i")) == ["manifest.json", "v=1", "v=3", "v=4"]
    assert Store.migrate({"schema_version": 2, "version": 7})["tables"]["files"] == 7


def test_postings_give_the_same_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made, size = match.index_postings(docs, "doc_id", "text"), match.corpus_size(docs, "text")
    words = [r["term"] for r in match.term_stats(docs, "doc_id", "text").orderBy(match.F.desc("df"), "term").limit(3).collect()]
    pair = docs.where("length(text) > 200").orderBy("doc_id").first()["text"]
    first = T.plain_tokens(pair)[:2]
    for query in (words[0], " ".join(words), ".".join(first), f"{words[1]} {'.'.join(first)}", "nothingofthekind", "-"):
        want = [tuple(r) for r in match.keyword_search(docs, "doc_id", "text", query, 20).collect()]
        assert [tuple(r) for r in match.search_postings(made, size, query, 20).collect()] == want, query


@pytest.mark.parametrize(("text", "size", "want"), [("aa bb cc dd", 5, "dd"), ("aa bb cc dd", 6, "cc dd"), ("short", 9, "short"), ("abcdef", 3, "def"), ("ab cd ", 3, "cd"), ("\u00e9\u00e9 \u00e9", 4, "\u00e9"), ("x", 0, "")])
def test_overlap_suffix(text, size, want):
    assert chunker.overlap_suffix(text.encode(), size).decode() == want


def test_chunker_trims_all_white_space_and_reports_long_lines(spark):
    assert [c.text for c in chunker.chunk_text("\u00a0\u3000first\u2003\n\u2009\nsecond")] == ["first\u2003\n\nsecond"]
    df = spark.createDataFrame([("a", "x" * ((1 << 20) + 1)), ("b", "fine")], "p string, t string")
    assert [r["file_path"] for r in chunker.chunk_documents(df, "p", "t").collect()] == ["b"]
    assert [tuple(r) for r in chunker.chunk_errors(df, "p", "t").collect()] == [("a", "line too long")]


def test_parent_and_tokens(spark):
    df = spark.createDataFrame([("a.md",), ("/a.md",), ("/x/y/a.md",)], "path string")
    assert [r[0] for r in df.select(T.parent(T.F.col("path"))).collect()] == [None, "/", "/x/y"]
    odd = "ab\ue000c d_e ½"
    row = spark.createDataFrame([(odd,)], "t string").select(T.tokens(T.F.col("t"))).first()[0]
    assert T.plain_tokens(odd) == row


def test_a_sibling_of_the_path_base_does_not_win(tmp_path):
    for name in ("b", "bc"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.md").write_text("x")
    (tmp_path / "b" / "g.md").write_text("x")
    (tmp_path / "bc" / "g.md").write_text("x")
    env = {"TIDEWATER_ROOTS": f"{tmp_path}/bc,{tmp_path}/b", "TIDEWATER_INDEX_DIR": str(tmp_path / "i"), "TIDEWATER_PATH_BASE": f"{tmp_path}/b"}
    assert Settings.from_env(env).resolve("g.md") == f"{tmp_path}/b/g.md"


def test_extraction_that_hangs_is_an_error():
    def slow(data):
        time.sleep(5)
        return Extracted("late")

    registry = Registry()
    registry.register("slow", slow, [".slow"])
    began = time.monotonic()
    assert registry.extract_within(".slow", b"", 0.2)[0] == "error" and time.monotonic() - began < 3
    assert registry.extract_within(".txt", b"fine", 5)[:2] == ("ok", "fine")
