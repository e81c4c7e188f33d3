"""A query for each operator of the engine, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import checks
from tarnlake.checks import customers
from tarnlake.engine import Engine
from tarnlake.operators import relational
from tarnlake.plans.compiler import compile_select
from tarnlake.plans.parser import parse
from tarnlake.sources.tables import KEYS, parquet_lookup, scratch_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FLAGSHIP = (
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity < 25 "
    "GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1 ORDER BY l_returnflag, l_linestatus LIMIT 10"
)


def run(spark: SparkSession, sf_dir: str, sql: str, compat: bool = False) -> DataFrame:
    """A SELECT of the dialect over the Parquet tables of a folder."""
    return compile_select(parse(sql), parquet_lookup(spark, sf_dir), compat, spark)


def dialect(name: str, sql: str, oracle: str | None = None, compat: bool = False) -> None:
    """Registers a SELECT; oracle: where DuckDB writes it otherwise."""
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, sql, compat)
    ORACLES[name] = oracle or sql


dialect("flagship", FLAGSHIP)
# projection and expressions
dialect("scan_project_star", "SELECT * FROM nation")
dialect("scan_project_cols", "SELECT n_name, n_regionkey FROM nation")
dialect("table_star", "SELECT n.*, n_nationkey + 1 AS next FROM nation AS n", "SELECT n.*, CAST(n_nationkey + 1 AS BIGINT) AS next FROM nation AS n")
dialect("alias_arith", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_tax AS x, (l_quantity + 1) * 2 - l_linenumber AS y FROM lineitem")
dialect("divide_safe", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / (l_linenumber - 1) AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / NULLIF(l_linenumber - 1, 0) AS x FROM lineitem")
dialect("unary_minus", "SELECT o_orderkey, -o_totalprice AS x, -(-o_custkey) AS y FROM orders")
dialect("concat_plus", "SELECT p_partkey, p_brand + '-' + p_type AS x FROM part", "SELECT p_partkey, p_brand || '-' || p_type AS x FROM part")
dialect("literals", "SELECT 1 AS a, 2.5 AS b, 'it''s' AS c, TRUE AS d", "SELECT CAST(1 AS INTEGER) AS a, CAST(2.5 AS DOUBLE) AS b, 'it''s' AS c, TRUE AS d")
# predicates
for _name, _sign in (("eq", "="), ("neq", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    dialect(f"filter_{_name}", f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_sign} 24")
dialect("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND NOT o_custkey > 100")
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%s%r_'", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%s%r_'")
dialect("filter_not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE 'S%'")
dialect("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
dialect("filter_not_in", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 1 + 2)")
dialect("filter_between", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 50")
dialect("filter_is_null", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
dialect("filter_is_not_null", "SELECT d.doc_id, toxic FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL")
# joins
dialect("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
dialect("join_left", "SELECT o_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
dialect("join_right", "SELECT l_partkey, l_quantity, o_orderkey FROM lineitem RIGHT OUTER JOIN orders ON l_orderkey = o_orderkey")
dialect("join_theta", "SELECT a.n_name AS x, r_name AS y FROM nation AS a JOIN region ON n_regionkey < r_regionkey")
dialect("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect("join_three_way", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey INNER JOIN region ON n_regionkey = r_regionkey")
dialect("join_where", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'O'")
dialect("join_agg", "SELECT n_name, COUNT(*) AS n, MAX(c_acctbal) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING COUNT(*) > 10")
dialect("join_star", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
# aggregation
dialect("agg_global", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, AVG(l_quantity) AS a FROM lineitem")
dialect("agg_group_by", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, COUNT(l_partkey) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 5 AND MIN(o_orderkey) > 10", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5 AND MIN(o_orderkey) > 10")
dialect("agg_count_distinct", "SELECT event_type, COUNT(DISTINCT user_id) AS n FROM events GROUP BY event_type")
dialect("agg_min_max", "SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment")
dialect("agg_avg", "SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand")
dialect("agg_sum_expr", "SELECT l_returnflag, SUM(l_quantity * l_linenumber) AS x, 1 + SUM(l_quantity) / COUNT(*) AS y FROM lineitem GROUP BY l_returnflag")
dialect("agg_sum_int", "SELECT p_brand, SUM(p_size) AS x FROM part GROUP BY p_brand", "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS x FROM part GROUP BY p_brand")
dialect("agg_sum_distinct", "SELECT p_brand, SUM(DISTINCT p_size) AS x FROM part GROUP BY p_brand", "SELECT p_brand, CAST(SUM(DISTINCT p_size) AS BIGINT) AS x FROM part GROUP BY p_brand")
dialect("agg_empty_input", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity < 0")
dialect("agg_bare_column", "SELECT n_regionkey, n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, min_by(n_name, n_nationkey) AS n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", compat=True)
# distinct, sort, top-k
dialect("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("distinct_ordered", "SELECT DISTINCT n_regionkey AS r FROM nation ORDER BY r DESC LIMIT 3")
dialect("order_multi", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey")
dialect("order_unselected", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
dialect("order_nulls", "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey ORDER BY l_partkey, o_orderkey LIMIT 20", "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey ORDER BY l_partkey NULLS FIRST, o_orderkey LIMIT 20")
dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
dialect("limit_key_order", "SELECT o_orderkey, o_custkey FROM orders LIMIT 5 OFFSET 5", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 5")
dialect("avg_distinct", "SELECT p_brand, AVG(DISTINCT p_size) AS x FROM part GROUP BY p_brand")
dialect("distinct_aggregate", "SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey")
dialect("order_by_place", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 9")
dialect("order_by_expression", "SELECT o_orderkey FROM orders ORDER BY -o_totalprice, o_orderkey + 1 LIMIT 9")
dialect("order_by_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS double_price FROM orders ORDER BY double_price, k LIMIT 9")
dialect("order_descending_nulls", "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey ORDER BY l_partkey DESC, o_orderkey LIMIT 20", "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey ORDER BY l_partkey DESC NULLS LAST, o_orderkey LIMIT 20")
dialect("unaliased_names", "SELECT p_brand, COUNT(*), SUM(p_size), COUNT(DISTINCT p_type), MIN(p_size) + 1 FROM part GROUP BY p_brand", 'SELECT p_brand, COUNT(*) AS "count(*)", CAST(SUM(p_size) AS BIGINT) AS "sum(p_size)", COUNT(DISTINCT p_type) AS "count(DISTINCT p_type)", CAST(MIN(p_size) + 1 AS BIGINT) AS "(min(p_size) + 1)" FROM part GROUP BY p_brand')
dialect("quoted_names", 'SELECT "n_name" AS "the name", "n"."n_regionkey" FROM "nation" AS "n" WHERE "n_nationkey" > 3')
dialect("integers_of_64_bits", "SELECT p_partkey, p_size * 1000000000 AS x, p_size * 1000000000 + p_size AS y FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) * 1000000000 AS x, CAST(p_size AS BIGINT) * 1000000000 + p_size AS y FROM part")
dialect("select_without_from", "SELECT 2 + 3 * 4 AS x, NOT FALSE AS y, NULL AS z", "SELECT CAST(14 AS BIGINT) AS x, TRUE AS y, NULL AS z")
# the looser mode
_OUTER = "orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"
dialect("compat_null_neq", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey <> 5", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey IS DISTINCT FROM 5", compat=True)
dialect("compat_null_lowest", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey < 100", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey IS NULL OR l_partkey < 100", compat=True)
dialect("compat_null_not", f"SELECT o_orderkey FROM {_OUTER} WHERE NOT l_partkey", f"SELECT o_orderkey FROM {_OUTER} WHERE NOT COALESCE(l_partkey <> 0, FALSE)", compat=True)
dialect("compat_text_numbers", "SELECT c_custkey FROM customer WHERE c_custkey >= '42' AND '10' > '9' AND c_acctbal < '100.5'", "SELECT c_custkey FROM customer WHERE c_custkey >= 42 AND c_acctbal < 100.5", compat=True)
dialect("compat_plus", "SELECT p_partkey, p_brand + p_size AS x, '3' + '4' AS y FROM part", "SELECT p_partkey, p_brand || CAST(p_size AS VARCHAR) AS x, '7' AS y FROM part", compat=True)

dialect("compat_truth_of_text", "SELECT p_partkey FROM part WHERE p_name AND NOT '0' AND NOT ''", "SELECT p_partkey FROM part WHERE p_name IS NOT NULL AND p_name NOT IN ('', '0', 'false')", compat=True)
dialect("compat_truth_of_null", "SELECT n_nationkey FROM nation WHERE NOT NULL", "SELECT n_nationkey FROM nation", compat=True)
dialect("compat_in", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey IN (5, 7, NULL)", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey IN (5, 7) OR l_partkey IS NULL", compat=True)
dialect("compat_not_in_text", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN ('7', '8.0', 'x')", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (7, 8)", compat=True)
dialect("compat_arithmetic", f"SELECT o_orderkey, l_partkey - 1 AS a, l_partkey * 2 AS b, o_orderstatus * 3 AS c, '7' - 2 AS d FROM {_OUTER}", f"SELECT o_orderkey, COALESCE(l_partkey, 0) - 1 AS a, COALESCE(l_partkey, 0) * 2 AS b, CAST(0 AS DOUBLE) AS c, CAST(5 AS DOUBLE) AS d FROM {_OUTER}", compat=True)
dialect("compat_like_null", f"SELECT o_orderkey FROM {_OUTER} WHERE l_returnflag LIKE ''", f"SELECT o_orderkey FROM {_OUTER} WHERE COALESCE(l_returnflag, '') ILIKE ''", compat=True)
dialect("compat_between", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey BETWEEN NULL AND 40", f"SELECT o_orderkey, l_partkey FROM {_OUTER} WHERE l_partkey IS NULL OR l_partkey <= 40", compat=True)
dialect("compat_group_order", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority LIMIT 3", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY MIN(o_orderkey) LIMIT 3", compat=True)
dialect("compat_bare_column_of_join", "SELECT n_regionkey, s_name, COUNT(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(s_name, n_nationkey * 1000000 + s_suppkey) AS s_name, COUNT(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey", compat=True)


def registered(name: str, oracle: str) -> Callable[[Query], Query]:
    def put(q: Query) -> Query:
        QUERIES[name], ORACLES[name] = q, oracle
        return q

    return put


@registered("key_range_scan", "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.key_range(spark.read.parquet(f"{sf_dir}/orders.parquet"), KEYS["orders"], 100, 200)


@registered("point_get", "SELECT * FROM orders WHERE o_orderkey = 77")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.point_get(spark.read.parquet(f"{sf_dir}/orders.parquet"), KEYS["orders"], 77)


def loose(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT of the looser mode over t (id, a): orders whose price, without cents where it has none, is a text."""
    e = Engine(spark, scratch_root(spark), "compat")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("p"), "o_custkey")).otherwise(F.floor("o_totalprice").cast("string"))
    e.register("t", rows.select(F.col("o_orderkey").alias("id"), text.alias("a")), "id")
    return e.sql(sql).df


_T = "(SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'p' || o_custkey ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR) END AS a FROM orders) AS t"
_KEY = "a IS NOT NULL{0}, TRY_CAST(a AS DOUBLE) IS NULL{0}, TRY_CAST(a AS DOUBLE){0}, a{0}"
for _name, _sql, _oracle in (
    ("compat_order_text", "SELECT id, a FROM t WHERE a ORDER BY a, id LIMIT 25", f"SELECT id, a FROM {_T} WHERE a IS NOT NULL AND a <> '0' ORDER BY {_KEY.format('')}, id LIMIT 25"),
    ("compat_order_text_descending", "SELECT id, a FROM t ORDER BY a DESC, id LIMIT 1500", f"SELECT id, a FROM {_T} ORDER BY {_KEY.format(' DESC')}, id LIMIT 1500"),
    ("compat_order_null_first", "SELECT id, a FROM t ORDER BY a, id LIMIT 5", f"SELECT id, a FROM {_T} WHERE a IS NULL ORDER BY id LIMIT 5"),
    ("compat_min_max_text", "SELECT MIN(a) AS lo, MAX(a) AS hi FROM t WHERE NOT a LIKE 'p%'", f"SELECT CAST(MIN(CAST(a AS BIGINT)) AS VARCHAR) AS lo, CAST(MAX(CAST(a AS BIGINT)) AS VARCHAR) AS hi FROM {_T} WHERE a NOT LIKE 'p%'"),
    ("compat_sum_text", "SELECT SUM(a) AS s, AVG(a) AS m, COUNT(a) AS n FROM t", f"SELECT SUM(TRY_CAST(a AS DOUBLE)) AS s, AVG(TRY_CAST(a AS DOUBLE)) AS m, COUNT(a) AS n FROM {_T}"),
    ("compat_join_null_keys", "SELECT x.id AS i, y.id AS j FROM t AS x JOIN t AS y ON x.a = y.a WHERE x.id < 60 AND y.id < 60", f"SELECT x.id AS i, y.id AS j FROM {_T.replace('AS t', 'AS x')} JOIN {_T.replace('AS t', 'AS y')} ON x.a IS NOT DISTINCT FROM y.a WHERE x.id < 60 AND y.id < 60"),
):
    QUERIES[_name], ORACLES[_name] = (lambda spark, sf_dir, sql=_sql: loose(spark, sf_dir, sql)), _oracle


BASE = "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer"
ALL = "SELECT * FROM c"


@registered("insert_values", f"{BASE} UNION ALL VALUES (-1, 'new', 3, 1.5), (-2, 'it''s', NULL, NULL)")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("INSERT INTO c VALUES (-1, 'new', 3, 1.5)")
    e.sql("INSERT INTO c (name, id) VALUES ('it''s', -2)")
    return e.sql(ALL).df


@registered("upsert", f"SELECT * FROM ({BASE}) WHERE id NOT IN (5, 6) UNION ALL VALUES (5, 'last', 1, 2.0), (6, 'six', 2, 3.0), (-7, 'seven', 3, 4.0)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("INSERT INTO c VALUES (5, 'first', 1, 1.0), (6, 'six', 2, 3.0), (5, 'last', 1, 2.0), (-7, 'seven', 3, 4.0)")
    return e.sql(ALL).df


@registered("update", "SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN c_name || '!' ELSE c_name END AS name, CAST(CASE WHEN c_nationkey = 3 THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS nation, c_acctbal AS balance FROM customer")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("UPDATE c SET nation = nation + 100, name = name + '!' WHERE nation = 3")
    return e.sql(ALL).df


@registered("delete", f"SELECT * FROM ({BASE}) WHERE NOT (balance < 0 OR nation IN (1, 2))")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("DELETE FROM c WHERE balance < 0 OR nation IN (1, 2)")
    return e.sql(ALL).df


@registered("index_scan", f"SELECT * FROM ({BASE}) WHERE nation = 7")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("CREATE INDEX by_nation ON c(nation)")
    e.sql("INSERT INTO c VALUES (-1, 'gone', 7, 0.0)")
    e.sql("DELETE FROM c WHERE id = -1")
    e.compact()
    return e.scan_index("by_nation", 7)


@registered("drop_and_create", "SELECT CAST(1 AS BIGINT) AS id, 'again' AS name")
def drop_and_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("DROP TABLE c")
    e.sql("CREATE TABLE c (id INT PRIMARY KEY, name TEXT)")
    e.sql("INSERT INTO c VALUES (1, 'again')")
    return Engine(spark, e.catalog.folder.root).sql(ALL).df


@registered("commit_publishes", f"{BASE} UNION ALL VALUES (-1, 'kept', 1, 1.0)")
def commit_publishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    with e.transaction() as s:
        s.sql("INSERT INTO c VALUES (-1, 'kept', 1, 1.0)")
    return Engine(spark, e.catalog.folder.root).sql(ALL).df


@registered("rollback_preserves", BASE)
def rollback_preserves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("BEGIN")
    e.sql("DELETE FROM c WHERE id > 10")
    e.sql("INSERT INTO c VALUES (-1, 'gone', 1, 1.0)")
    e.sql("ROLLBACK")
    return e.sql(ALL).df


@registered("isolation", "SELECT 'inside' AS place, COUNT(*) + 1 AS n FROM customer UNION ALL SELECT 'outside', COUNT(*) FROM customer")
def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    s = e.new_session()
    s.sql("BEGIN")
    s.sql("INSERT INTO c VALUES (-1, 'staged', 1, 1.0)")
    inside, outside = (x.sql("SELECT COUNT(*) AS n FROM c").df for x in (s, e))
    return inside.select(F.lit("inside").alias("place"), "n").unionByName(outside.select(F.lit("outside").alias("place"), "n"))


@registered("compact_preserves", f"{BASE} UNION ALL VALUES (-1, 'a', 1, 1.0), (-2, 'b', 2, 2.0)")
def compact_preserves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    e.sql("INSERT INTO c VALUES (-1, 'a', 1, 1.0)")
    e.sql("INSERT INTO c VALUES (-2, 'b', 2, 2.0)")
    e.compact()
    e.gc(1)
    return e.sql(ALL).df


@registered("as_of", BASE)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customers(spark, sf_dir)
    before = e.versions()[-1]
    e.sql("DELETE FROM c WHERE nation > 3")
    return e.as_of(before).sql(ALL).df


QUERIES |= checks.QUERIES
ORACLES |= checks.ORACLES
