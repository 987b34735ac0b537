"""Watching folders, web search over HTTP, OCR of scanned files, PDF streams."""

import http.server
import json
import threading
import time
import zlib

import pytest

from tidewater.__main__ import main
from tidewater.service import Engine
from tidewater.session import Session
from tidewater.settings import Settings
from tidewater.sources import extract
from tidewater.sources.extract import Registry
from tidewater.streaming.source import FileEventReader, changes, snapshot
from tidewater.streaming.watcher import Watcher


def test_changes_between_polls(tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "b.md").write_text("x")
    before = snapshot([str(tmp_path)])
    assert list(before) == [f"{tmp_path}/a.md"]
    reader = FileEventReader([str(tmp_path)])
    rows, first = reader.read(reader.initialOffset())
    assert [r[1:] for r in rows] == [(None, "tick")]
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "c.md").write_text("x")
    (tmp_path / "a.md").write_text("longer")
    assert changes(before, snapshot([str(tmp_path)])) == [(f"{tmp_path}/a.md", "write"), (f"{tmp_path}/new/c.md", "create")]
    rows, second = reader.read(first)
    seen = list(rows)
    assert [r[2] for r in seen] == ["write", "create", "tick"] and list(reader.readBetweenOffsets(first, second)) == seen
    reader.commit(second)
    (tmp_path / "a.md").unlink()
    rows, third = reader.read(second)
    assert [r[2] for r in rows] == ["remove", "tick"] and list(reader.readBetweenOffsets(first, second)) == []


def test_watcher_follows_and_flushes(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.md").write_text("first text\n")
    env = {"TIDEWATER_ROOTS": str(root), "TIDEWATER_INDEX_DIR": str(tmp_path / "i"), "TIDEWATER_WATCH_PATHS": str(root), "TIDEWATER_WATCH_DEBOUNCE": "500ms"}
    engine = Engine(spark, Settings.from_env(env))

    def names():
        return [r["path"].rsplit("/", 1)[-1] for r in engine.list_files().collect()]

    def until(want):
        end = time.monotonic() + 40
        while names() != want and time.monotonic() < end and watcher.query.isActive:
            time.sleep(0.5)
        assert names() == want, watcher.query.exception()

    watcher = Watcher(engine)
    query = watcher.start(str(tmp_path / "state"))
    try:
        assert names() == ["a.md"]
        while query.lastProgress is None and query.isActive:
            time.sleep(0.2)
        (root / "sub").mkdir()
        (root / "sub" / "b.md").write_text("second text\n")
        until(["a.md", "b.md"])
        (root / "a.md").unlink()
        until(["b.md"])
        (root / "c.md").write_text("third text\n")
    finally:
        watcher.stop()
    assert sorted(names()) == ["b.md", "c.md"] and not query.isActive
    (root / "sub" / "b.md").unlink()
    Watcher(engine).settle()
    assert sorted(names()) == ["c.md"]
    with pytest.raises(ValueError):
        Watcher(Engine(spark, Settings.from_env({k: v for k, v in env.items() if "WATCH" not in k})))


def test_web_search_and_rerank_over_http(spark, tmp_path):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def log_message(self, *args):
            return

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            if body["query"] == "fail":
                answer, code = {"msg": "no"}, 500
            elif self.path == "/v1/rerank":
                answer, code = {"results": [{"index": 1, "relevance_score": 0.5}, {"index": 7, "relevance_score": 0.4}, {"index": 0, "relevance_score": 0.9}]}, 200
            else:
                answer, code = {"code": 200, "data": {"webPages": {"value": [{"id": "", "name": "N", "url": "u", "snippet": "s", "summary": ""}]}}}, 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

    (tmp_path / "a.md").write_text("shard realm realm\n")
    (tmp_path / "b.md").write_text("the shard realm\n")
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service) as service:
        threading.Thread(target=service.serve_forever, daemon=True).start()
        env = {"TIDEWATER_ROOTS": str(tmp_path), "TIDEWATER_INDEX_DIR": str(tmp_path / ".i"), "TIDEWATER_WEB_KEY": "k", "TIDEWATER_WEB_URL": f"http://127.0.0.1:{service.server_port}/"}
        session = Session.open(Engine(spark, Settings.from_env(env)))
        found = session.search_web("realm")
        assert (found["count"], found["results"][0]["id"], found["results"][0]["snippet"]) == (1, "u", "s")
        assert asked[0][:2] == ("/v1/web-search", "Bearer k") and asked[0][2]["count"] == 10
        with pytest.raises(RuntimeError):
            session.search_web("fail")
        session.index_paths([str(tmp_path)])
        plain = session.search_local("shard realm")["results"]
        again = session.search_local("shard realm", rerank=True)["results"]
        assert [r["id"] for r in again] == [plain[1]["id"], plain[0]["id"]] and [r["score"] for r in again] == [0.5, 0.9]
        bare = Session.open(Engine(spark, Settings.from_env({k: v for k, v in env.items() if "WEB" not in k})))
        for call in (lambda: bare.search_local("shard", rerank=True), lambda: bare.search_web("x")):
            with pytest.raises(ValueError, match="API key"):
                call()
        service.shutdown()


def test_pdf_streams(monkeypatch):
    monkeypatch.setattr(extract.shutil, "which", lambda name: None)
    packed = zlib.compress(b"BT [(Hel) -20 (lo \\(all\\))] TJ (next) Tj ET")
    data = b"%PDF-1.4\nstream\n(plain) Tj\nendstream\nstream\r\n" + packed + b"\nendstream"
    assert Registry().extract(".pdf", data)[:2] == ("ok", "plain\nHello (all)\nnext")


def test_scanned_pdf(monkeypatch):
    commands = []

    def run(command, timeout=30):
        commands.append(command)
        if command[0] == "pdftoppm":
            for n in (1, 2, 3):
                open(f"{command[-1]}-{n}.png", "wb").close()
            return ""
        if command[0] == "tesseract":
            if command[1].endswith("-2.png"):
                raise ValueError("unreadable")
            return f"text of {command[1][-5]} {command[-1]}\n"
        return " \f"

    monkeypatch.setattr(extract.shutil, "which", lambda name: f"/bin/{name}")
    monkeypatch.setattr(extract, "_run", run)
    status, text, warn, _ = Registry(language="deu").extract(".pdf", b"%PDF-1.4")
    assert status == "ok" and text.split() == "text of 1 deu text of 3 deu".split() and len(warn) == 1 and "unreadable" in warn[0]
    assert commands[1][:4] == ["pdftoppm", "-png", "-r", "150"]
    assert Registry(language=None).extract(".pdf", b"%PDF-1.4")[0] == "skip" and Registry(language=None).extract(".png", b"x")[0] == "skip"


def test_commands_reject_what_they_do_not_know():
    for argv in ([], ["other"], ["watch"], ["search"], ["search", "x", "--limit"]):
        with pytest.raises(SystemExit):
            main(argv)
