"""Queries that show what statements alone don't: observed outcomes of the engine, service, client and command line as rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import service as http
from tarnlake.client import Client
from tarnlake.engine import Engine
from tarnlake.errors import AuthError, ConflictError, DialectError, EngineError, QueryError, ServiceConnectionError
from tarnlake.plans.parser import parse
from tarnlake.repl import session as repl
from tarnlake.sources.tables import scratch_root
from tarnlake.text import format_result

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def shown(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, "null" if v is None else str(v)) for k, v in rows], "what string, value string")


def expected(*rows: tuple[str, str]) -> str:
    """SQL of rows (what, value); a value that begins with = is an SQL expression."""
    cell = lambda v: v[1:] if v.startswith("=") else "'" + v.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST({cell(v)} AS VARCHAR) AS value" for k, v in rows)


def observed(*rows: tuple[str, str], mode: str = "ansi") -> Callable:
    """Registers a function of (engine over the customers, sf_dir) that gives rows (what, value)."""

    def put(f: Callable[[Engine], list[tuple[str, object]]]) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(spark, f(customers(spark, sf_dir, mode)))

        QUERIES[f.__name__], ORACLES[f.__name__] = query, expected(*rows)
        return f

    return put


def customers(spark: SparkSession, sf_dir: str, mode: str = "ansi") -> Engine:
    """A new database with the customers in a keyed table."""
    e = Engine(spark, scratch_root(spark), mode)
    e.sql("CREATE TABLE c (id INT PRIMARY KEY, name TEXT NOT NULL, nation INT, balance FLOAT)")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    e.session.upsert("c", rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return e


def error(run: Callable[[], object]) -> str:
    """The class of the error that a call raises, or none."""
    try:
        run()
    except EngineError as e:
        return type(e).__name__
    return "none"


N = "=(SELECT COUNT(*) FROM customer)"


@observed(("has 5", "True"), ("has -5", "False"), ("count", N))
def has_and_count(e: Engine) -> list[tuple[str, object]]:
    return [("has 5", e.has("c", 5)), ("has -5", e.has("c", -5)), ("count", e.count("c"))]


@observed(("by_nation", "by_nation"), ("other column", "null"), ("after drop", "null"), ("dropped twice", "QueryError"), ("rows", "=(SELECT COUNT(*) FROM customer WHERE c_nationkey = 7)"))
def index_definitions(e: Engine) -> list[tuple[str, object]]:
    e.sql("CREATE INDEX by_nation ON c(nation)")
    found, n = e.find_index("c", "nation"), e.scan_index("by_nation", 7).count()
    other = e.find_index("c", "name")
    e.sql("DROP INDEX by_nation")
    return [("by_nation", found), ("other column", other), ("after drop", e.find_index("c", "nation")), ("dropped twice", error(lambda: e.sql("DROP INDEX by_nation"))), ("rows", n)]


@observed(("repeated values", "QueryError"), ("created", "none"), ("second row", "QueryError"), ("other row", "none"), ("count", "=(SELECT COUNT(*) + 1 FROM customer)"))
def unique_index(e: Engine) -> list[tuple[str, object]]:
    run = lambda sql: error(lambda: e.sql(sql))
    first = e.get("c", 1)["name"]
    return [("repeated values", run("CREATE UNIQUE INDEX u ON c(nation)")), ("created", run("CREATE UNIQUE INDEX u ON c(name)")), ("second row", run(f"INSERT INTO c VALUES (-1, '{first}', 1, 1.0)")), ("other row", run("INSERT INTO c VALUES (-1, 'another', 1, 1.0)")), ("count", e.count("c"))]


@observed(("put", "placed"), ("removed", "1"), ("removed again", "0"), ("count", N))
def put_and_remove(e: Engine) -> list[tuple[str, object]]:
    e.put("c", {"id": -3, "name": "placed"})
    return [("put", e.get("c", -3)["name"]), ("removed", e.remove("c", -3)), ("removed again", e.remove("c", -3)), ("count", e.count("c"))]


@observed(("null in a list of rows", "QueryError"), ("key taken", "QueryError"), ("null by update", "QueryError"), ("count", N), ("names", "=(SELECT COUNT(DISTINCT c_name) FROM customer)"), ("versions", "2"))
def statements_are_atomic(e: Engine) -> list[tuple[str, object]]:
    run = lambda sql: error(lambda: e.sql(sql))
    out = [("null in a list of rows", run("INSERT INTO c VALUES (-1, 'x', 1, 1.0), (-2, NULL, 1, 1.0)")), ("key taken", run("UPDATE c SET id = 1 WHERE id < 3")), ("null by update", run("UPDATE c SET name = NULL WHERE id = 1"))]
    return [*out, ("count", e.count("c")), ("names", e.query("SELECT COUNT(DISTINCT name) AS n FROM c")[0]["n"]), ("versions", len(e.versions()))]


@observed(("inside", "=(SELECT COUNT(*) + 1 FROM customer)"), ("base still read", N), ("after", "=(SELECT COUNT(*) + 1 FROM customer)"), ("gc of what is rolled back", "True"))
def gc_keeps_staged(e: Engine) -> list[tuple[str, object]]:
    """Collection while a transaction is open takes neither what it has staged nor what it reads."""
    e.sql("CREATE TABLE other (id INT PRIMARY KEY)")
    s, reader = e.new_session(), e.new_session()
    reader.sql("BEGIN")
    s.sql("BEGIN")
    s.sql("INSERT INTO c VALUES (-1, 'staged', 1, 1.0)")
    for k in range(3):
        e.sql(f"INSERT INTO other VALUES ({k})")
    e.gc(1)
    inside = s.query("SELECT COUNT(*) AS n FROM c")[0]["n"]
    s.sql("COMMIT")
    e.sql("UPDATE c SET nation = 1")
    e.gc(1)
    base = reader.query("SELECT COUNT(*) AS n FROM c")[0]["n"]
    reader.sql("ROLLBACK")
    e.gc(1)
    e.sql("BEGIN")
    e.sql("INSERT INTO c VALUES (-2, 'gone', 1, 1.0)")
    e.sql("ROLLBACK")
    return [("inside", inside), ("base still read", base), ("after", e.count("c")), ("gc of what is rolled back", e.gc(1).endswith("0 part(s)"))]


@observed(("repeated key", "QueryError"), ("null key", "QueryError"), ("null name", "QueryError"), ("good rows", "none"), ("count", "=(SELECT COUNT(*) + 1 FROM customer)"), ("new", "p"))
def upsert_rejects_duplicates(e: Engine) -> list[tuple[str, object]]:
    rows = lambda *r: e.spark.createDataFrame(list(r), "id bigint, name string, nation bigint, balance double")
    run = lambda df: error(lambda: e.session.upsert("c", df))
    out = [("repeated key", run(rows((1, "p", 1, 1.0), (1, "q", 1, 1.0)))), ("null key", run(rows((None, "p", 1, 1.0)))), ("null name", run(rows((1, None, 1, 1.0)))), ("good rows", run(rows((1, "p", 1, 1.0), (-1, "n", 1, None))))]
    return [*out, ("count", e.count("c")), ("new", e.get("c", 1)["name"])]


@observed(("delete", "QueryError"), ("begin", "QueryError"), ("upsert", "QueryError"), ("compact", "QueryError"), ("rows of the view", N), ("rows now", "0"))
def as_of_is_read_only(e: Engine) -> list[tuple[str, object]]:
    view = e.as_of(e.versions()[-1])
    e.sql("DELETE FROM c")
    out = [(k, error(run)) for k, run in (("delete", lambda: view.sql("DELETE FROM c WHERE id = 1")), ("begin", lambda: view.sql("BEGIN")), ("upsert", lambda: view.put("c", {"id": 1, "name": "x"})), ("compact", view.compact))]
    return [*out, ("rows of the view", view.count("c")), ("rows now", e.count("c"))]


@observed(("conflict", "ConflictError"), ("other table", "none"), ("count", N))
def writers_conflict(e: Engine) -> list[tuple[str, object]]:
    e.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    a, b = e.new_session(), e.new_session()
    for s, sql in ((a, "INSERT INTO t VALUES (1)"), (b, "INSERT INTO t VALUES (2)")):
        s.sql("BEGIN")
        s.sql(sql)
    a.sql("COMMIT")
    out = [("conflict", error(lambda: b.sql("COMMIT")))]
    b.sql("BEGIN")
    b.sql("INSERT INTO t VALUES (3)")
    e.sql("INSERT INTO c VALUES (-1, 'x', 1, 1.0)")
    e.remove("c", -1)
    return [*out, ("other table", error(lambda: b.sql("COMMIT"))), ("count", e.count("c"))]


@observed(("tables", "c, t"), ("indexes", "by_nation"), ("columns", "id, name, nation, balance"), ("rows", N), ("row counter", N), ("written", "True"), ("read", "True"), ("bytes", "True"), ("manifest", "c"))
def listings_and_stats(e: Engine) -> list[tuple[str, object]]:
    e.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    e.sql("CREATE INDEX by_nation ON c(nation)")
    e.count("c")
    s, schema = e.stats(), e.schema("c")
    return [("tables", ", ".join(e.tables())), ("indexes", ", ".join(i["name"] for i in e.indexes())), ("columns", ", ".join(c["name"] for c in schema["columns"])), ("rows", schema["row_count"]), ("row counter", s["rows"]), ("written", s["files_written"] >= 1), ("read", s["files_read"] >= 1), ("bytes", s["bytes"] > 0), ("manifest", json.loads(e.manifest())["tables"]["c"]["name"])]


@observed(("keys", "True"), ("nations", "True"), ("none", "0"))
def distinct_estimates(e: Engine) -> list[tuple[str, object]]:
    e.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    n = e.count("c")
    return [("keys", abs(e.estimate_distinct("c", "id") - n) < 0.15 * n), ("nations", abs(e.estimate_distinct("c", "nation") - 25) <= 4), ("none", e.estimate_distinct("t", "id"))]


@observed(("inserts", "60"), ("found", "20"), ("timed", "True"))
def micro_benchmark(e: Engine) -> list[tuple[str, object]]:
    got = e.benchmark(60)
    return [("inserts", got["inserts"]), ("found", got["found"]), ("timed", min(got["insert_s"], got["commit_s"], got["get_s"]) >= 0)]


@observed(("line 1", "id | name"), ("line 2", "---+-----"), ("line 3", "1  | one "), ("line 4", "2  | NULL"), ("line 5", "(2 rows)"), ("message", "Deleted 2 row(s)"))
def text_sink(e: Engine) -> list[tuple[str, object]]:
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    e.sql("INSERT INTO t VALUES (1, 'one'), (2, NULL)")
    lines = format_result(e.sql("SELECT * FROM t ORDER BY id")).splitlines()
    return [*[(f"line {i}", x) for i, x in enumerate(lines, 1)], ("message", format_result(e.sql("DELETE FROM t")))]


@observed((".tables", "c"), (".indexes", "No indexes"), (".schema c", "id INT PRIMARY KEY NOT NULL"), (".stats", "True"), (".commit", "Committed"), (".compact", "Nothing to compact"), (".gc 1", "True"), (".manifest", "True"), (".help", "True"), (".bench 20", "20"), ("SELECT 1 AS x", "x"), ("bad statement", "Error"), (".nope", "Unknown command: .nope (.help lists all)"), ("after .quit", "0"))
def command_line(e: Engine) -> list[tuple[str, object]]:
    ask = lambda *lines: list(repl(e, lines))
    first = lambda *lines: ask(*lines)[0]
    return [
        (".tables", first(".tables")), (".indexes", first(".indexes")), (".schema c", first(".schema c").splitlines()[0]), (".stats", json.loads(first(".stats"))["num_tables"] == 1), (".commit", first(".commit")), (".compact", first(".compact")), (".gc 1", first(".gc 1").startswith("Removed")), (".manifest", json.loads(first(".manifest"))["version"] > 0), (".help", ".quit" in first(".help")), (".bench 20", json.loads(first(".bench 20"))["inserts"]),
        ("SELECT 1 AS x", first("SELECT 1", "AS x;").splitlines()[0].strip()), ("bad statement", first("SELEC;").split(":")[0]), (".nope", first(".nope")), ("after .quit", len(ask(".quit", ".tables"))),
    ]


def over(service: http.Service) -> Callable[[str, str, dict, bytes | None], tuple[int, bytes]]:
    """A client's connection to a service of this process, without a network."""

    def send(method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, bytes]:
        status, value = service.handle(method, url.removeprefix("http://here"), headers, body or b"")
        return status, json.dumps(value, default=str).encode()

    return send


@observed(("GET health", "200"), ("no key", "401"), ("POST execute", "200"), ("rows", "1"), ("GET tables", "200"), ("GET schema", "200"), ("schema of nothing", "404"), ("GET indexes", "200"), ("GET stats", "200"), ("POST commit", "200"), ("POST compact", "200"), ("POST gc", "200"), ("POST session", "200"), ("DELETE session", "200"), ("DELETE session again", "404"), ("no body", "400"), ("no statement", "400"), ("bad statement", "200 False"), ("elsewhere", "404"))
def http_endpoints(e: Engine) -> list[tuple[str, object]]:
    s = http.Service(e, "secret")
    ask = lambda method, path, body=None, key="secret": s.handle(method, f"/api/v1/{path}", {"Authorization": f"Bearer {key}"}, b"" if body is None else json.dumps(body).encode())
    got = ask("POST", "execute", {"sql": "SELECT 1 AS x"})
    name = ask("POST", "session")[1]["session_id"]
    bad = ask("POST", "execute", {"sql": "SELEC"})
    calls = [("GET tables", ("GET", "tables")), ("GET schema", ("GET", "tables/c/schema")), ("schema of nothing", ("GET", "tables/nope/schema")), ("GET indexes", ("GET", "indexes")), ("GET stats", ("GET", "stats")), ("POST commit", ("POST", "commit")), ("POST compact", ("POST", "compact")), ("POST gc", ("POST", "gc", {"keep": 2})), ("POST session", ("POST", "session")), ("DELETE session", ("DELETE", f"session/{name}")), ("DELETE session again", ("DELETE", f"session/{name}")), ("no body", ("POST", "execute")), ("no statement", ("POST", "execute", {"sql": " "})), ("elsewhere", ("GET", "nope"))]
    return [("GET health", s.handle("GET", "/api/v1/health", {}, b"")[0]), ("no key", ask("GET", "tables", key="wrong")[0]), ("POST execute", got[0]), ("rows", got[1]["row_count"]), ("bad statement", f"{bad[0]} {bad[1]['ok']}"), *[(k, ask(*a)[0]) for k, a in calls]]


@observed(("BEGIN without a session", "400"), ("BEGIN", "True"), ("second BEGIN", "409"), ("unseen outside", N), ("COMMIT", "True"), ("seen outside", "=(SELECT COUNT(*) + 1 FROM customer)"), ("idle session ends", "404"), ("and rolls back", "=(SELECT COUNT(*) + 1 FROM customer)"))
def http_sessions(e: Engine) -> list[tuple[str, object]]:
    s = http.Service(e)
    ask = lambda sql, name=None: s.handle("POST", "/api/v1/execute", {}, json.dumps({"sql": sql, "session": name}).encode())
    a, b = (s.handle("POST", "/api/v1/session", {}, b"")[1]["session_id"] for _ in range(2))
    count = lambda: ask("SELECT COUNT(*) AS n FROM c")[1]["rows"][0][0]
    out = [("BEGIN without a session", ask("BEGIN")[0]), ("BEGIN", ask("BEGIN", a)[1]["ok"]), ("second BEGIN", ask("BEGIN", b)[0])]
    ask("INSERT INTO c VALUES (-1, 'x', 1, 1.0)", a)
    out += [("unseen outside", count()), ("COMMIT", ask("COMMIT", a)[1]["ok"]), ("seen outside", count())]
    ask("BEGIN", b)
    ask("INSERT INTO c VALUES (-2, 'y', 1, 1.0)", b)
    s.reap(s.sessions[b][1] + http.IDLE_S + 1)
    return [*out, ("idle session ends", ask("SELECT 1", b)[0]), ("and rolls back", count())]


@observed(("execute", "1"), ("query", "{'n': 'x'}"), ("tables", "c, t"), ("schema", "id, n"), ("indexes", "0"), ("stats", "2"), ("compact", "True"), ("gc", "True"), ("health", "True"), ("transaction", "2"), ("rolled back", "ValueError"), ("after", "2"), ("bad statement", "QueryError"), ("wrong key", "AuthError"), ("no service", "ServiceConnectionError"), ("health of none", "False"))
def client_calls(e: Engine) -> list[tuple[str, object]]:
    s = http.Service(e, "k")
    c = Client("http://here", "k", over(s))

    def none(*_: object) -> tuple[int, bytes]:
        raise OSError("refused")

    def two(inner: Client) -> int:
        inner.execute("INSERT INTO t VALUES (2, 'y')")
        return inner.query("SELECT COUNT(*) AS n FROM t")[0]["n"]

    def fails(inner: Client) -> None:
        inner.execute("DELETE FROM t")
        raise ValueError

    c.execute("CREATE TABLE t (id INT PRIMARY KEY, n TEXT)")
    out = [("execute", c.execute("INSERT INTO t VALUES (1, 'x')")["row_count"]), ("query", c.query("SELECT n FROM t")[0]), ("tables", ", ".join(c.tables())), ("schema", ", ".join(x["name"] for x in c.schema("t")["columns"])), ("indexes", len(c.indexes())), ("stats", c.stats()["num_tables"])]
    out += [("compact", bool(c.compact())), ("gc", c.gc().startswith("Removed")), ("health", c.health()), ("transaction", c.transaction(two))]
    try:
        c.transaction(fails)
    except ValueError as x:
        out.append(("rolled back", type(x).__name__))
    return [*out, ("after", c.query("SELECT COUNT(*) AS n FROM t")[0]["n"]), ("bad statement", error(lambda: c.execute("SELEC"))), ("wrong key", error(Client("http://here", "no", over(s)).tables)), ("no service", error(Client("http://here", "k", none).tables)), ("health of none", Client("http://here", "k", none).health())]


#: Statements that the grammar doesn't have, and such that can't be run.
UNREADABLE = ("SELEC 1", "SELECT", "SELECT FROM c", "SELECT * FROM", "SELECT id FROM c extra tokens", "SELECT SUM(*) FROM c", "INSERT INTO c VALUES", "CREATE TABLE t ()", "SELECT 'open", "SELECT (1", "DELETE c", "UPDATE c SET", "SELECT id FROM c LIMIT x")
UNRUNNABLE = ("SELECT nope FROM c", "SELECT * FROM nope", "SELECT name, COUNT(*) FROM c", "SELECT * FROM c GROUP BY name", "SELECT id FROM c HAVING id > 1", "SELECT id FROM c AS a JOIN c AS b ON a.id = b.id", "SELECT id FROM c WHERE SUM(id) > 1", "INSERT INTO c VALUES (1)", "INSERT INTO c (id, id) VALUES (1, 2)", "INSERT INTO c VALUES ('x', 'y', 1, 1)", "CREATE TABLE c (id INT)", "DROP TABLE nope", "CREATE INDEX i ON nope(x)", "CREATE INDEX i ON c(nope)", "ROLLBACK")


@observed(*[(x, "DialectError") for x in UNREADABLE if "'" not in x], *[(x, "QueryError") for x in UNRUNNABLE if "'" not in x], ("open text", "DialectError"), ("text for a number", "QueryError"), ("position", "12"), ("statement kept", "SELECT nope FROM c"), ("conflicts are engine errors", "True"))
def rejected_statements(e: Engine) -> list[tuple[str, object]]:
    named = {"SELECT 'open": "open text", "INSERT INTO c VALUES ('x', 'y', 1, 1)": "text for a number"}
    out: list[tuple[str, object]] = [(named.get(x, x), error(lambda x=x: e.sql(x))) for x in (*UNREADABLE, *UNRUNNABLE)]
    try:
        parse("SELECT 1 AS ")
    except DialectError as x:
        out.append(("position", x.position))
    try:
        e.sql("SELECT nope FROM c")
    except QueryError as x:
        out.append(("statement kept", x.sql))
    return [*out, ("conflicts are engine errors", issubclass(ConflictError, EngineError) and issubclass(AuthError, EngineError) and issubclass(ServiceConnectionError, EngineError))]


@observed(("created", "Table t created"), ("created again", "Table t already exists"), ("dropped index", "Index i does not exist"), ("inserted", "Inserted 2 row(s)"), ("updated", "Updated 1 row(s)"), ("deleted", "Deleted 2 row(s)"), ("dropped", "Table t dropped"), ("begin", "BEGIN"), ("commit", "COMMIT"))
def messages(e: Engine) -> list[tuple[str, object]]:
    said = [("created", "CREATE TABLE t (id INT PRIMARY KEY)"), ("created again", "CREATE TABLE IF NOT EXISTS t (id INT)"), ("dropped index", "DROP INDEX IF EXISTS i"), ("inserted", "INSERT INTO t VALUES (1), (2)"), ("updated", "UPDATE t SET id = 3 WHERE id = 2"), ("deleted", "DELETE FROM t"), ("dropped", "DROP TABLE t"), ("begin", "BEGIN"), ("commit", "COMMIT")]
    return [(k, e.sql(sql).message) for k, sql in said]


@observed(("one file of many", "True"), ("rows", N), ("changed", "1"), ("compacted", "True"), ("file with the key", "1"))
def changes_touch_few_files(e: Engine) -> list[tuple[str, object]]:
    """A change of one row rewrites one file; a compacted table is ranged by key, so one file holds a key."""
    rows = e.table("c").select("id", "name", "nation", "balance").repartitionByRange(6, "id")
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, nation INT, balance FLOAT)")
    e.session.upsert("t", rows)
    before = set(e.table_info("t").parts)
    n = e.sql("UPDATE t SET name = 'changed' WHERE id = 3").row_count
    after = set(e.table_info("t").parts)
    one = len(before) > 1 and len(before - after) == 1
    done = e.compact().startswith("Compacted")
    files = e.table("t").where("id = 3").select(F.input_file_name()).distinct().count()
    return [("one file of many", one), ("rows", e.count("t")), ("changed", n), ("compacted", done), ("file with the key", files)]
