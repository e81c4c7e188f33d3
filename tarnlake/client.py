"""A client of the HTTP service."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any, TypeVar

from tarnlake.errors import AuthError, QueryError, ServiceConnectionError

R = TypeVar("R")


class Client:
    def __init__(self, url: str, key: str = "", send: Callable[[str, str, dict, bytes | None], tuple[int, bytes]] | None = None) -> None:
        """send: replaces the network, for tests."""
        self.url, self.key, self.send, self.session = url.rstrip("/"), key, send or over_http, ""

    def request(self, method: str, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            status, raw = self.send(method, f"{self.url}/api/v1/{path}", headers, None if body is None else json.dumps(body).encode())
        except OSError as e:
            raise ServiceConnectionError(str(e)) from e
        value = json.loads(raw)
        if status == 401:
            raise AuthError(value.get("error", "unauthorized"))
        if not value.get("ok"):
            raise QueryError(value.get("error", f"status {status}"), (body or {}).get("sql"))
        return value

    def execute(self, sql: str) -> dict:
        return self.request("POST", "execute", {"sql": sql} | ({"session": self.session} if self.session else {}))

    def query(self, sql: str) -> list[dict]:
        got = self.execute(sql)
        return [dict(zip(got.get("columns", ()), row, strict=True)) for row in got.get("rows", ())]

    def transaction(self, run: Callable[[Client], R]) -> R:
        """run(client) between BEGIN and COMMIT; an error rolls back. The session always ends."""
        inner = Client(self.url, self.key, self.send)
        inner.session = self.request("POST", "session")["session_id"]
        try:
            inner.execute("BEGIN")
            try:
                out = run(inner)
            except BaseException:
                inner.execute("ROLLBACK")
                raise
            inner.execute("COMMIT")
            return out
        finally:
            self.request("DELETE", f"session/{inner.session}")

    def tables(self) -> list[str]:
        return self.request("GET", "tables").get("tables", [])

    def schema(self, table: str) -> dict:
        return self.request("GET", f"tables/{table}/schema")["schema"]

    def indexes(self) -> list[dict]:
        return self.request("GET", "indexes").get("indexes", [])

    def stats(self) -> dict:
        return self.request("GET", "stats")["stats"]

    def flush(self) -> None:
        self.request("POST", "commit")

    def compact(self) -> str:
        return self.request("POST", "compact")["message"]

    def gc(self, keep: int = 5) -> str:
        return self.request("POST", "gc", {"keep": keep})["message"]

    def health(self) -> bool:
        try:
            return bool(self.request("GET", "health")["ok"])
        except (ServiceConnectionError, AuthError, QueryError, ValueError):
            return False

    def close(self) -> None:
        """Nothing is held open."""


def over_http(method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, Any]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method)) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
