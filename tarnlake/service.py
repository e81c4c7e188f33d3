"""A small HTTP service over an engine, under /api/v1, with JSON bodies."""

from __future__ import annotations

import json
import secrets
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PySparkException

from tarnlake.engine import Engine, Session
from tarnlake.errors import EngineError
from tarnlake.plans import syntax as S
from tarnlake.plans.parser import parse

IDLE_S, CHECK_S = 300, 30
#: Rows that a query returns at most; the answer says if there are more.
MOST_ROWS = 10_000


class Reply(Exception):
    def __init__(self, status: int, **body: object) -> None:
        self.status, self.body = status, {"ok": status == 200} | body


class Service:
    """Requests as method calls: handle(method, path, headers, body) gives a status and a JSON value."""

    def __init__(self, engine: Engine, key: str = "", most_rows: int = MOST_ROWS) -> None:
        self.engine, self.key, self.most_rows = engine, key, most_rows
        self.sessions: dict[str, tuple[Session, float]] = {}
        self.owner: str | None = None
        self.lock = threading.RLock()

    def handle(self, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, dict]:
        try:
            parts = path.split("?")[0].strip("/").split("/")
            if parts[:2] != ["api", "v1"]:
                raise Reply(404, error="not found")
            if (method, parts[2:]) == ("GET", ["health"]):
                raise Reply(200)
            if self.key and headers.get("Authorization") != f"Bearer {self.key}":
                raise Reply(401, error="unauthorized")
            with self.lock:
                self.route(method, parts[2:], body)
            raise Reply(404, error="not found")
        except Reply as r:
            return r.status, r.body
        except (EngineError, PySparkException) as e:
            return 500, {"ok": False, "error": str(e)}

    def route(self, method: str, parts: list[str], body: bytes) -> None:
        match method, *parts:
            case "POST", "execute":
                self.execute(body)
            case "POST", "session":
                name = secrets.token_hex(16)
                self.sessions[name] = self.engine.new_session(), time.time()
                raise Reply(200, session_id=name)
            case "DELETE", "session", name:
                if name not in self.sessions:
                    raise Reply(404, error="session not found")
                self.end(name)
                raise Reply(200)
            case "GET", "tables":
                raise Reply(200, tables=self.engine.tables())
            case "GET", "tables", name, "schema":
                try:
                    found = self.engine.schema(name)
                except EngineError as e:
                    raise Reply(404, error=str(e)) from e
                raise Reply(200, schema=found)
            case "GET", "indexes":
                raise Reply(200, indexes=self.engine.indexes())
            case "GET", "stats":
                raise Reply(200, stats=self.engine.stats())
            case "POST", "commit":
                self.engine.commit()
                raise Reply(200, message="committed")
            case "POST", "compact":
                raise Reply(200, message=self.engine.compact())
            case "POST", "gc":
                keep = self.json(body or b"{}").get("keep", 5)
                raise Reply(200, message=self.engine.gc(keep if isinstance(keep, int) and keep > 0 else 5))

    @staticmethod
    def json(body: bytes) -> dict:
        try:
            value = json.loads(body)
        except ValueError:
            value = None
        if not isinstance(value, dict):
            raise Reply(400, error="invalid request body")
        return value

    def execute(self, body: bytes) -> None:
        request = self.json(body)
        sql, name = request.get("sql"), request.get("session")
        if not isinstance(sql, str) or not sql.strip():
            raise Reply(400, error="sql is required")
        session = self.engine.session
        if name:
            if name not in self.sessions:
                raise Reply(404, error="session not found")
            session = self.sessions[name][0]
            self.sessions[name] = session, time.time()
        began = time.time()
        try:
            statement = parse(sql)
            if statement == S.Transaction("begin"):
                if not name:
                    raise Reply(400, error="BEGIN requires a session")
                if self.owner not in (None, name):
                    raise Reply(409, error="another transaction is active")
            result = session.run(statement)
            if name and (session.in_transaction or self.owner == name):
                self.owner = name if session.in_transaction else None
            out: dict = {"row_count": result.row_count}
            if result.df is not None:
                rows = result.rows(self.most_rows + 1)
                out = {"columns": result.columns, "rows": rows[: self.most_rows], "row_count": min(len(rows), self.most_rows)}
                if len(rows) > self.most_rows:
                    out["message"] = f"only the first {self.most_rows} rows"
            if result.message:
                out["message"] = result.message
        except (EngineError, PySparkException) as e:
            raise Reply(200, ok=False, error=str(e)) from e
        raise Reply(200, time_ms=(time.time() - began) * 1000, **out)

    def end(self, name: str) -> None:
        session, _ = self.sessions.pop(name)
        if session.in_transaction:
            session.rollback()
        if self.owner == name:
            self.owner = None

    def reap(self, now: float | None = None) -> None:
        """Ends sessions that have been idle too long."""
        now = time.time() if now is None else now
        with self.lock:
            for name in [n for n, (_, at) in self.sessions.items() if now - at > IDLE_S]:
                self.end(name)

    def serve(self, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """A server in the background; shutdown() ends it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, value = service.handle(self.command, self.path, dict(self.headers), body)
                raw = json.dumps(value, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            do_GET = do_POST = do_DELETE = answer

            def log_message(self, *_: object) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def clock() -> None:
            while True:
                time.sleep(CHECK_S)
                service.reap()

        threading.Thread(target=clock, daemon=True).start()
        return server
