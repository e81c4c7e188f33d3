import json

import pytest

from tarnlake.client import Client
from tarnlake.engine import Engine
from tarnlake.errors import AuthError, QueryError, ServiceConnectionError
from tarnlake.repl import session
from tarnlake.service import IDLE_S, Service
from tarnlake.sources.tables import scratch_root


@pytest.fixture
def service(spark):
    return Service(Engine(spark, scratch_root(spark)), "secret", most_rows=3)


def call(service, method, path, body=None, key="secret"):
    raw = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else b""
    return service.handle(method, f"/api/v1/{path}", {"Authorization": f"Bearer {key}"} if key else {}, raw)


def test_keys_and_bad_requests(service):
    assert call(service, "GET", "health", key="") == (200, {"ok": True})
    assert [call(service, "GET", "tables", key=k)[0] for k in ("", "wrong", "secret")] == [401, 401, 200]
    assert call(service, "POST", "execute", {"sql": ""})[0] == 400
    assert call(service, "POST", "execute", b"not json")[0] == 400
    assert call(service, "GET", "nowhere")[0] == 404


def test_statements(service):
    run = lambda sql, **more: call(service, "POST", "execute", {"sql": sql} | more)
    assert run("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL);")[1]["message"] == "Table users created"
    assert run("INSERT INTO users VALUES (1, 'Alice'), (2, 'B'), (3, 'C'), (4, 'D')")[1]["row_count"] == 4
    status, got = run("SELECT id, name FROM users ORDER BY id")
    assert status == 200 and got["columns"] == ["id", "name"] and got["rows"][0] == [1, "Alice"] and got["row_count"] == 3 and "first 3" in got["message"]
    status, got = run("SELECT * FROM nope")
    assert (status, got["ok"]) == (200, False) and "nope" in got["error"]
    assert call(service, "GET", "tables/users/schema")[1]["schema"]["columns"][1] == {"name": "name", "type": "text", "nullable": False, "primary_key": False}
    assert call(service, "GET", "tables/nope/schema")[0] == 404
    assert call(service, "GET", "stats")[1]["stats"]["num_tables"] == 1
    assert [call(service, "POST", p, {})[0] for p in ("commit", "compact", "gc")] == [200, 200, 200]


def test_sessions(service):
    run = lambda sql, **more: call(service, "POST", "execute", {"sql": sql} | more)
    run("CREATE TABLE t (id INT PRIMARY KEY)")
    assert run("BEGIN TRANSACTION")[0] == 400
    a, b = (call(service, "POST", "session")[1]["session_id"] for _ in range(2))
    assert run("BEGIN", session=a)[1]["ok"] and run("BEGIN", session=b)[0] == 409
    run("INSERT INTO t VALUES (1)", session=a)
    assert run("SELECT * FROM t")[1]["rows"] == [] and run("SELECT * FROM t", session=a)[1]["rows"] == [[1]]
    assert [call(service, "DELETE", f"session/{a}")[0] for _ in range(2)] == [200, 404]
    assert run("SELECT * FROM t")[1]["rows"] == [] and run("BEGIN", session=b)[1]["ok"]
    service.reap(service.sessions[b][1] + IDLE_S + 1)
    assert service.sessions == {} and service.owner is None and run("SELECT 1", session=b)[0] == 404


def test_client(service):
    log = []

    def send(method, url, headers, body):
        log.append((method, url.removeprefix("http://x/api/v1/")))
        status, value = service.handle(method, url.removeprefix("http://x"), headers, body or b"")
        return status, json.dumps(value).encode()

    c = Client("http://x//", "secret", send)
    c.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    assert c.transaction(lambda tx: tx.execute("INSERT INTO t VALUES (1, 'a')")["row_count"]) == 1
    assert c.query("SELECT * FROM t") == [{"id": 1, "v": "a"}]
    with pytest.raises(QueryError) as e:
        c.transaction(lambda tx: tx.execute("INSERT INTO t VALUES (2)"))
    assert e.value.sql.startswith("INSERT") and log[-1][0] == "DELETE"
    assert c.query("SELECT COUNT(*) AS n FROM t") == [{"n": 1}]
    assert c.tables() == ["t"] and c.schema("t")["table"] == "t" and c.indexes() == [] and c.health()
    c.flush(), c.compact(), c.gc(), c.stats(), c.close()
    with pytest.raises(AuthError):
        Client("http://x", "no", send).tables()

    def fail(*_):
        raise OSError("down")

    with pytest.raises(ServiceConnectionError):
        Client("http://x", send=fail).tables()
    assert Client("http://x", send=fail).health() is False


def test_over_the_network(service):
    server = service.serve(0)
    c = Client(f"http://127.0.0.1:{server.server_port}", "secret")
    assert c.health() and c.query("SELECT 1 AS one") == [{"one": 1}]
    server.shutdown()


def test_command_line(spark):
    e = Engine(spark, scratch_root(spark))
    lines = [".tables", "CREATE TABLE t", "(id INT PRIMARY KEY, n TEXT NOT NULL);", "INSERT INTO t VALUES (1, 'a');", "SELECT *", "FROM t;", ".schema t", ".indexes", ".stats", ".commit", ".compact", ".gc 2", ".bench 5", ".manifest", ".help", ".what", "SELECT nope FROM t;", ".quit", ".tables"]
    out = list(session(e, lines))
    assert out[0] == "No tables" and "Table t created" in out[1] and "(1 rows)" in out[3]
    assert out[4] == "id INT PRIMARY KEY NOT NULL\nn TEXT NOT NULL" and "Unknown command" in out[13] and out[14].startswith("Error") and len(out) == 15
