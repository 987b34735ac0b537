"""A thin HTTP adapter: POST /v1/search, POST /v1/index, GET /v1/files,
GET /v1/stats, GET /healthz.  With a token set, requests need it as bearer."""

from __future__ import annotations

import hmac
import json
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tidewater.session import Session

BUDGET_S, HEADER_S, MAX_BODY = 60.0, 5.0, 1 << 20


class Server(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, address: tuple[str, int], session: Session, token: str | None = None, budget: float = BUDGET_S):
        super().__init__(address, Handler)
        self.session, self.token, self.budget = session, token, budget
        self.pool = ThreadPoolExecutor(8)

    def server_close(self) -> None:
        super().server_close()
        self.pool.shutdown(wait=False, cancel_futures=True)


class Handler(BaseHTTPRequestHandler):
    server: Server
    timeout = HEADER_S
    routes = {("POST", "/v1/search"), ("POST", "/v1/index"), ("GET", "/v1/files"), ("GET", "/v1/stats"), ("GET", "/healthz")}

    def log_message(self, *args) -> None:
        return

    def _send(self, code: int, body: dict) -> None:
        raw = json.dumps(body, default=str).encode()
        self.send_response(code)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _body(self) -> dict:
        size = int(self.headers.get("Content-Length") or 0)
        if size > MAX_BODY:
            raise ValueError("body is too large")
        body = json.loads(self.rfile.read(size) or b"{}")
        if not isinstance(body, dict):
            raise ValueError("body must be an object")
        return body

    def _handle(self) -> None:
        where, session = urlsplit(self.path), self.server.session
        if where.path not in {p for _, p in self.routes}:
            return self._send(404, {"error": "not found"})
        if (self.command, where.path) not in self.routes:
            return self._send(405, {"error": "method not allowed"})
        if where.path == "/healthz":
            return self._send(200, {"status": "ok"})
        given = self.headers.get("Authorization") or ""
        if self.server.token and not hmac.compare_digest(given.encode(), f"Bearer {self.server.token}".encode()):
            return self._send(401, {"error": "unauthorized"})
        try:
            if where.path == "/v1/search":
                b = self._body()
                work = lambda: session.search_local(str(b.get("query", "")), int(b.get("limit", 10)), str(b.get("mode", "")), bool(b.get("rerank", False)))
            elif where.path == "/v1/index":
                b = self._body()
                work = lambda: session.index_paths(list(b.get("paths") or []), bool(b.get("force", False)))
            elif where.path == "/v1/files":
                work = lambda: session.list_indexed_files(parse_qs(where.query).get("prefix", [None])[0])
            else:
                work = session.index_stats
            self._send(200, self.server.pool.submit(work).result(self.server.budget))
        except TooLate:
            self._send(500, {"error": "the request took too long"})
        except (ValueError, TypeError, PermissionError, FileNotFoundError) as e:
            self._send(400, {"error": str(e)})
        except Exception as e:  # noqa: BLE001 - every failure is an answer
            self._send(500, {"error": f"{type(e).__name__}: {e}"[:500]})

    do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = _handle
