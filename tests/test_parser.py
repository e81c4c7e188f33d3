import pytest
from hypothesis import given, settings, strategies as st

from tarnlake.errors import DialectError
from tarnlake.plans import syntax as S
from tarnlake.plans.parser import parse, tokenize


def kinds(sql):
    return [(t.kind, t.text) for t in tokenize(sql)][:-1]


def test_tokens():
    assert kinds("a <= b >= c != d <> e") == [("name", "a"), ("sign", "<="), ("name", "b"), ("sign", ">="), ("name", "c"), ("sign", "!="), ("name", "d"), ("sign", "<>"), ("name", "e")]
    assert kinds("'it''s' 3.14 -42") == [("string", "it's"), ("number", "3.14"), ("sign", "-"), ("number", "42")]
    assert kinds('Select "my col" FROM T') == [("keyword", "select"), ("name", "my col"), ("keyword", "from"), ("name", "T")]


@pytest.mark.parametrize("bad", ["'open", '"open', "SELECT #", "a ! b", "SELECT 1 %"])
def test_lexer_errors_have_positions(bad):
    with pytest.raises(DialectError) as e:
        tokenize(bad)
    assert "position" in str(e.value)


def test_and_binds_tighter_than_or():
    where = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c = 3").where
    assert where.op == "or" and where.right.op == "and"


def test_precedence_of_arithmetic_and_not():
    e = parse("SELECT NOT a + 2 * -b > 3 FROM t").items[0].value
    assert e.op == "not" and e.of.op == ">" and e.of.left.op == "+" and e.of.left.right.op == "*"
    assert parse("SELECT a-1 FROM t").items[0].value == S.Binary("-", S.Column("a"), S.Literal(1))


def test_select_clauses():
    s = parse("SELECT DISTINCT a AS x, COUNT(*), SUM(DISTINCT b) FROM t LEFT OUTER JOIN u AS v ON t.id = v.id WHERE a IS NOT NULL GROUP BY a, t.b HAVING COUNT(*) > 1 ORDER BY x DESC, b LIMIT 10 OFFSET 5;")
    assert s.distinct and s.joins[0].kind == "left" and s.joins[0].relation == S.Relation("u", "v")
    assert s.items[0].alias == "x" and s.items[1].value == S.Aggregate("count", None) and s.items[2].value.distinct
    assert s.group == (S.Column("a"), S.Column("b", "t")) and s.order[0].descending and (s.limit, s.offset) == (10, 5)


def test_statements():
    t = parse("CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY, n VARCHAR(9) NOT NULL, key REAL, b BLOB NULL)")
    assert [(c.name, c.type, c.nullable, c.key) for c in t.columns] == [("id", "int", False, True), ("n", "text", False, False), ("key", "float", True, False), ("b", "blob", True, False)]
    assert t.lenient
    assert parse("CREATE UNIQUE INDEX i ON t(a, b)") == S.CreateIndex("i", "t", ("a", "b"), True)
    assert parse("DROP INDEX IF EXISTS i") == S.DropIndex("i", True)
    assert parse("INSERT INTO t (a) VALUES (-1), (NULL)").rows == ((S.Literal(-1),), (S.Literal(None),))
    assert parse("UPDATE t SET a = a + 1, b = 'x' WHERE a IN (1, 2)").changes[1] == ("b", S.Literal("x"))
    assert parse("DELETE FROM t") == S.Delete("t")
    assert [parse(x).kind for x in ("BEGIN", "begin transaction", "COMMIT;", "ROLLBACK")] == ["begin", "begin", "commit", "rollback"]


@pytest.mark.parametrize(
    "bad",
    ["", "SELECT", "SELECT * FROM", "SELECT a FROM t UNION SELECT b FROM u", "SELECT a FROM t; SELECT b FROM u", "SELECT a FROM t, u", "SELECT SUM(*) FROM t", "SELECT a FROM t LIMIT -1", "SELECT a FROM t LIMIT 1.5", "INSERT INTO t VALUES (a)", "INSERT INTO t VALUES (1 + 1)", "CREATE TABLE t (a DATE)", "UPDATE t SET 1 = 2", "SELECT a NOT b FROM t", "SELECT upper(a) FROM t", "DROP VIEW v"],
)
def test_what_is_left_over_or_unknown_is_an_error(bad):
    with pytest.raises(DialectError):
        parse(bad)


@settings(deadline=None)
@given(st.text(alphabet="abc'\"-_ \n%é", max_size=20))
def test_any_text_survives_as_a_literal(text):
    quoted = text.replace("'", "''")
    assert parse(f"SELECT '{quoted}'").items[0].value == S.Literal(text)


def test_names_of_output_columns():
    assert [S.shown(i.value) for i in parse("SELECT COUNT(*), COUNT(DISTINCT x), SUM(a), a + 1, t.b FROM t").items] == ["count(*)", "count(DISTINCT x)", "sum(a)", "(a + 1)", "t.b"]
