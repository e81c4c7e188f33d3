import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tarnlake.engine import Engine
from tarnlake.errors import ConflictError, DialectError, EngineError, QueryError
from tarnlake.sources.tables import scratch_root
from tarnlake.text import format_result


@pytest.fixture
def db(spark):
    return Engine(spark, scratch_root(spark))


@pytest.fixture
def loose(spark):
    return Engine(spark, scratch_root(spark), "compat")


def values(e, sql):
    return [tuple(r) for r in e.sql(sql).rows()]


def test_crud(db):
    assert db.sql("CREATE TABLE users (id INT PRIMARY KEY, name TEXT, age INT)").message == "Table users created"
    r = db.sql("INSERT INTO users VALUES (1, 'Alice', 30)")
    assert (r.message, r.row_count) == ("Inserted 1 row(s)", 1)
    assert db.sql("INSERT INTO users VALUES (2, 'Bob', 25), (3, 'Charlie', 35)").row_count == 2
    assert db.sql("SELECT * FROM users").columns == ["id", "name", "age"]
    assert values(db, "SELECT name FROM users WHERE age > 26 ORDER BY name") == [("Alice",), ("Charlie",)]
    assert db.sql("UPDATE users SET name = 'new', age = age + 1 WHERE id = 1").message == "Updated 1 row(s)"
    assert values(db, "SELECT name, age FROM users WHERE id = 1") == [("new", 31)]
    assert db.sql("DELETE FROM users WHERE id = 2").row_count == 1
    assert values(db, "SELECT COUNT(*) FROM users") == [(2,)]
    assert db.schema("users")["row_count"] == 2
    assert db.sql("DELETE FROM users").row_count == 2
    assert values(db, "SELECT COUNT(*), SUM(age) FROM users") == [(0, None)]
    assert db.sql("DROP TABLE users").message == "Table users dropped"
    with pytest.raises(QueryError, match="does not exist"):
        db.sql("SELECT * FROM users")


def test_upsert_keeps_the_last_row_of_a_key(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT, n INT)")
    db.sql("INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2), (1, 'c', 3)")
    db.sql("INSERT INTO t (v, id) VALUES ('d', 2), ('e', 9007199254740993)")
    assert values(db, "SELECT * FROM t ORDER BY id") == [(1, "c", 3), (2, "d", None), (9007199254740993, "e", None)]


def test_definitions(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT NOT NULL)")
    assert db.sql("CREATE TABLE IF NOT EXISTS T (x INT)").message == "Table T already exists"
    assert db.sql("DROP TABLE IF EXISTS nope").message == "Table nope does not exist"
    for bad in ("CREATE TABLE t (x INT)", "DROP TABLE nope", "CREATE INDEX i ON nope(x)", "CREATE INDEX IF NOT EXISTS i ON nope(x)", "CREATE INDEX i ON t(nope)", "DROP INDEX i", "INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (1, NULL)", "INSERT INTO t VALUES ('x', 'y')", "INSERT INTO t (id, nope) VALUES (1, 2)", "SELECT nope FROM t", "SELECT SUM(id) FROM t WHERE SUM(id) > 1", "SELECT v, COUNT(*) FROM t", "SELECT * FROM t GROUP BY v", "SELECT id FROM t HAVING id > 1"):
        with pytest.raises(QueryError):
            db.sql(bad)
    assert db.sql("CREATE INDEX i ON t(v)").message == "Index i created on t(v)"
    assert db.sql("CREATE INDEX IF NOT EXISTS i ON t(v)").message == "Index i already exists"
    assert db.indexes() == [{"name": "i", "table": "t", "columns": ["v"], "unique": False}]
    assert db.find_index("t", "v") == "i"
    db.sql("DROP TABLE t")
    assert db.indexes() == [] and db.tables() == []


def test_indexes_never_change_results(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, age INT, u TEXT)")
    db.sql("INSERT INTO t VALUES (1, 30, 'a'), (2, 25, 'b'), (3, 30, NULL)")
    db.sql("CREATE INDEX by_age ON t(age)")
    db.sql("CREATE UNIQUE INDEX by_u ON t(u)")
    assert sorted(r["id"] for r in db.scan_index("by_age", 30).collect()) == [1, 3]
    db.sql("UPDATE t SET age = 31 WHERE id = 1")
    assert [r["id"] for r in db.scan_index("by_age", 30).collect()] == [3]
    with pytest.raises(QueryError, match="unique"):
        db.sql("INSERT INTO t VALUES (4, 1, 'a')")
    db.compact()
    assert values(db, "SELECT id FROM t WHERE age = 30") == [(3,)]


def test_transactions(db, spark):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    db.sql("INSERT INTO t VALUES (1, 'before')")
    with pytest.raises(QueryError, match="not in a transaction"):
        db.sql("ROLLBACK")
    db.sql("BEGIN")
    with pytest.raises(QueryError, match="already in a transaction"):
        db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (2, 'during')")
    other = db.new_session()
    assert other.query("SELECT COUNT(*) AS n FROM t") == [{"n": 1}]
    assert db.query("SELECT COUNT(*) AS n FROM t") == [{"n": 2}]
    db.sql("ROLLBACK")
    assert db.query("SELECT COUNT(*) AS n FROM t") == [{"n": 1}]
    with pytest.raises(ZeroDivisionError), db.transaction() as s:
        s.sql("DELETE FROM t")
        raise ZeroDivisionError
    with db.transaction() as s:
        s.sql("INSERT INTO t VALUES (3, 'kept')")
    assert Engine(spark, db.catalog.folder.root).query("SELECT id FROM t ORDER BY id") == [{"id": 1}, {"id": 3}]


def test_concurrent_writers(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    db.sql("CREATE TABLE u (id INT PRIMARY KEY)")
    a, b = db.new_session(), db.new_session()
    a.sql("BEGIN"), b.sql("BEGIN")
    a.sql("INSERT INTO t VALUES (1)"), b.sql("INSERT INTO u VALUES (2)")
    a.sql("COMMIT"), b.sql("COMMIT")  # different tables
    assert values(db, "SELECT t.id, u.id FROM t JOIN u ON t.id < u.id") == [(1, 2)]
    a.sql("BEGIN")
    a.sql("INSERT INTO t VALUES (3)")
    db.sql("INSERT INTO t VALUES (4)")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    assert values(db, "SELECT id FROM t ORDER BY id") == [(1,), (4,)]


def test_versions_compaction_and_garbage(db, spark):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    for i in range(4):
        db.sql(f"INSERT INTO t VALUES ({i}, 'x')")
    before = db.versions()[-1]
    assert "4 parts" in db.compact() and db.compact() == "Nothing to compact"
    db.sql("DELETE FROM t WHERE id > 0")
    assert values(db.as_of(before), "SELECT COUNT(*) FROM t") == [(4,)]
    assert "Removed" in db.gc(100)
    db.gc(1)
    assert len(db.versions()) == 1 and values(db, "SELECT id FROM t") == [(0,)]
    assert db.stats()["num_tables"] == 1 and db.stats()["num_parts"] == 1
    with pytest.raises(EngineError):
        db.as_of(before)
    db.catalog.folder.create("{broken", "_meta", "v0000009999.json")
    with pytest.raises(EngineError, match="can't be read"):
        db.query("SELECT * FROM t")


def test_gc_between_insert_and_commit(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    db.sql("CREATE TABLE u (id INT PRIMARY KEY)")
    db.sql("INSERT INTO t VALUES (1, 'old')")
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (2, 'staged')")
    other = db.new_session()
    for k in range(3):
        other.sql(f"INSERT INTO u VALUES ({k})")
    db.gc(1)
    db.sql("COMMIT")
    assert values(db, "SELECT id FROM t ORDER BY id") == [(1,), (2,)] and db.catalog.leases() == []
    s = db.new_session()
    s.sql("BEGIN")
    s.sql("INSERT INTO t VALUES (3, 'lost')")
    staged = {p for p in s.staged.tables["t"].parts if p not in db.table_info("t").parts}
    db.catalog.discard(staged)  # as if a lease had run out
    with pytest.raises(ConflictError, match="removed"):
        s.sql("COMMIT")
    assert values(db, "SELECT COUNT(*) FROM t") == [(2,)]


def test_failed_statements_leave_nothing_behind(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT NOT NULL)")
    db.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    before = set(db.catalog.folder.names("data"))
    for bad in ("UPDATE t SET id = 1 WHERE id = 2", "UPDATE t SET v = NULL"):
        with pytest.raises(QueryError):
            db.sql(bad)
    rows = db.spark.createDataFrame([(3, "x"), (3, "y")], "id bigint, v string")
    with pytest.raises(QueryError, match="two rows"):
        db.session.upsert("t", rows)
    assert set(db.catalog.folder.names("data")) == before and db.catalog.leases() == [] and db.schema("t")["row_count"] == 2


def test_row_counts_without_recounting(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.session.upsert("t", db.spark.range(50).selectExpr("id", "id % 7 AS v").repartition(5))
    parts = set(db.table_info("t").parts)
    assert len(parts) == 5
    db.sql("DELETE FROM t WHERE id = 13")
    assert len(parts - set(db.table_info("t").parts)) == 1 and db.schema("t")["row_count"] == 49 == db.count("t")
    db.session.upsert("t", db.spark.range(40, 60).selectExpr("id", "-1 AS v"))
    assert db.schema("t")["row_count"] == 59 == db.count("t") and db.sql("UPDATE t SET v = 0 WHERE v < 0").row_count == 20
    assert db.schema("t")["row_count"] == 59 == db.count("t")


def test_other_stores(spark, tmp_path):
    """A database in a file system that isn't file:, as Hadoop mounts it."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./db", f"file:{tmp_path}")
    db = Engine(spark, "viewfs://store/db/x")
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    db.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    db.sql("UPDATE t SET v = 'c' WHERE id = 2")
    db.sql("DELETE FROM t WHERE id = 1")
    db.compact(), db.gc(1)
    assert values(Engine(spark, "viewfs://store/db/x"), "SELECT * FROM t") == [(2, "c")]


def test_compat_order(loose):
    loose.sql("CREATE TABLE t (id INT, a TEXT)")
    loose.sql("INSERT INTO t VALUES (1, '10'), (2, '9'), (3, NULL), (4, 'b'), (5, '1e1'), (6, '!'), (7, '')")
    assert [r[0] for r in values(loose, "SELECT id FROM t ORDER BY a, id")] == [3, 7, 6, 2, 1, 5, 4]
    assert [r[0] for r in values(loose, "SELECT id FROM t ORDER BY a DESC, id")] == [4, 5, 1, 2, 6, 7, 3]
    assert values(loose, "SELECT MIN(a), MAX(a) FROM t WHERE a > '5' AND a <> 'b'") == [("9", "1e1")]
    assert values(loose, "SELECT a, COUNT(*) FROM t GROUP BY a LIMIT 2") == [("10", 1), ("9", 1)]


def test_key_value_calls(db):
    db.sql("CREATE TABLE t (k TEXT PRIMARY KEY, v TEXT)")
    db.put("t", {"K": "b", "v": "2"})
    db.put("t", {"k": "a", "v": "1"})
    assert db.get("t", "a") == {"k": "a", "v": "1"} and db.get("t", "z") is None and db.has("t", "b")
    assert [r["k"] for r in db.scan("t").collect()] == ["a", "b"]
    assert [r["k"] for r in db.scan_range("t", "a", "b").collect()] == ["a"]
    assert db.remove("t", "a") == 1 and db.count("t") == 1
    assert db.benchmark(50)["found"] == 20


def test_update_of_the_key_rejects_collisions(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    db.sql("INSERT INTO t VALUES (1), (2)")
    with pytest.raises(QueryError, match="two rows"):
        db.sql("UPDATE t SET id = 2 WHERE id = 1")
    db.sql("UPDATE t SET id = id + 10")
    assert values(db, "SELECT id FROM t ORDER BY id") == [(11,), (12,)]


def test_select_semantics(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, n INT, x FLOAT)")
    db.sql("INSERT INTO t VALUES (3, 'Apple', NULL, 1.5), (1, 'banana', 0, 2.0), (2, 'a_b', 5, NULL)")
    assert values(db, "SELECT id FROM t LIMIT 2 OFFSET 1") == [(2,), (3,)]
    assert values(db, "SELECT id FROM t LIMIT 5 OFFSET 9") == []
    assert values(db, "SELECT id FROM t WHERE name LIKE 'A%' ORDER BY id") == [(2,), (3,)]
    assert values(db, "SELECT id FROM t WHERE name LIKE '%_b' ORDER BY id") == [(2,)]
    assert values(db, "SELECT n / 0, x / 2 FROM t ORDER BY id") == [(None, 1.0), (None, None), (None, 0.75)]
    assert values(db, "SELECT name FROM t ORDER BY n, id") == [("Apple",), ("banana",), ("a_b",)]
    assert values(db, "SELECT id FROM t WHERE n <> 5") == [(1,)]
    assert values(db, "SELECT a.id, b.id FROM t AS a JOIN t AS b ON a.id < b.id ORDER BY 1, 2") == [(1, 2), (1, 3), (2, 3)]
    assert values(db, "SELECT COUNT(n), COUNT(DISTINCT n), AVG(n) FROM t") == [(2, 2, 2.5)]
    assert values(db, "SELECT n + 1 AS m FROM t ORDER BY m DESC LIMIT 1") == [(6,)]
    with pytest.raises(QueryError, match="ambiguous"):
        db.sql("SELECT id FROM t AS a JOIN t AS b ON a.id = b.id")
    with pytest.raises(DialectError):
        db.sql("SELECT id FROM t EXTRA tokens")


def test_compat_semantics(loose):
    loose.sql("CREATE TABLE t (id INT, a TEXT, b TEXT, n INT)")  # without a key, the first column is it
    loose.sql("INSERT INTO t VALUES (1, '10', '9', 1), (2, 'b', 'a', NULL), (3, NULL, 'x', 0), (4, ' 12 ', '13', 7), (1, '9', '10', 2)")
    assert values(loose, "SELECT id FROM t WHERE a < b ORDER BY id") == [(1,), (3,), (4,)]
    assert values(loose, "SELECT id FROM t WHERE n <> 7 ORDER BY id") == [(1,), (2,), (3,)]
    assert values(loose, "SELECT id FROM t WHERE n = NULL") == [(2,)]
    assert values(loose, "SELECT id FROM t WHERE n < 1 ORDER BY id") == [(2,), (3,)]
    assert values(loose, "SELECT id FROM t WHERE NOT n ORDER BY id") == [(2,), (3,)]
    assert values(loose, "SELECT id FROM t WHERE n NOT IN (7, NULL) ORDER BY id") == [(1,), (3,)]
    assert values(loose, "SELECT a + b FROM t ORDER BY id") == [("19",), ("ba",), ("x",), (" 12 13",)]
    assert values(loose, "SELECT id FROM t WHERE a LIKE '' ORDER BY id") == [(3,)]
    assert values(loose, "SELECT n - 1, n * 2 FROM t ORDER BY id") == [(1, 4), (-1, 0), (-1, 0), (6, 14)]
    assert values(loose, "SELECT SUM(a), a FROM t") == [(9.0, "9")]


def test_compat_equality_still_reaches_the_scan(loose, capsys):
    loose.sql("CREATE TABLE t (id INT PRIMARY KEY, n INT)")
    loose.sql("INSERT INTO t VALUES (1, 2)")
    loose.sql("SELECT id FROM t WHERE id = 1").df.explain()
    assert "PushedFilters: [EqualNullSafe(id,1)]" in capsys.readouterr().out


def test_text_output(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    db.sql("INSERT INTO t VALUES (1, 'Alice'), (2, NULL)")
    shown = format_result(db.sql("SELECT * FROM t ORDER BY id"))
    assert shown == "id | name \n---+------\n1  | Alice\n2  | NULL \n(2 rows)\n" and format_result(db.sql("DELETE FROM t")) == "Deleted 2 row(s)"


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-9, 9)), min_size=1, max_size=6), st.booleans())
def test_any_upserts_leave_the_last_values(spark, rows, compacted):
    e = Engine(spark, scratch_root(spark))
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        if part:
            e.sql("INSERT INTO t VALUES " + ", ".join(map(str, part)))
    if compacted:
        e.compact()
    assert dict(values(e, "SELECT id, v FROM t")) == dict(rows)
