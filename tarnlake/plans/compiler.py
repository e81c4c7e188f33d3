"""Compiles a statement of the dialect to a lazy DataFrame, so that Catalyst sees the whole plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import QueryError
from tarnlake.functions import semantics as E
from tarnlake.operators import relational as R
from tarnlake.plans import syntax as S


@dataclass(frozen=True)
class Table:
    """A table as a relation: its rows, and the column whose order is the table's own."""

    df: DataFrame
    key: str | None = None


@dataclass(frozen=True)
class Bound:
    """A relation's columns: of each its name, the name it has inside the plan and its type."""

    alias: str
    columns: tuple[tuple[str, str, T.DataType], ...]
    key: str | None

    def find(self, name: str) -> tuple[str, str, T.DataType] | None:
        exact = [c for c in self.columns if c[0] == name]
        return (exact or [c for c in self.columns if c[0].lower() == name.lower()] or [None])[0]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bind(table: Table, alias: str, number: int) -> tuple[DataFrame, Bound]:
    names = [(f.name, f"r{number}_{f.name}", f.dataType) for f in table.df.schema.fields]
    key = next((inner for name, inner, _ in names if table.key and name.lower() == table.key.lower()), None)
    return table.df.select(*[quoted(n).alias(inner) for n, inner, _ in names]), Bound(alias, tuple(names), key)


@dataclass
class Scope:
    """Resolves columns; with groups, aggregates and bare columns become aggregation results."""

    relations: list[Bound]
    compat: bool
    grouped: bool = False
    groups: dict[str, T.DataType] = field(default_factory=dict)
    results: dict[str, Column] = field(default_factory=dict)  #: aggregations by the name they get
    aliases: dict[str, S.Expr] = field(default_factory=dict)
    order_key: tuple[str, ...] = ()  #: of the source rows: the keys of all relations, for bare columns in groups
    resolving: tuple[str, ...] = ()

    def locate(self, c: S.Column) -> tuple[str, T.DataType] | None:
        if c.table is not None:
            homes = [r for r in self.relations if r.alias.lower() == c.table.lower()]
            if not homes:
                raise QueryError(f"table {c.table} is not in the query")
        else:
            homes = self.relations
        found = [x for r in homes if (x := r.find(c.name))]
        if len(found) > 1:
            raise QueryError(f"column {S.shown(c)} is ambiguous")
        return (found[0][1], found[0][2]) if found else None

    def column(self, c: S.Column) -> E.Value:
        found = self.locate(c)
        if found is None:
            alias = c.name.lower()
            if c.table is None and alias in self.aliases and alias not in self.resolving:
                before, self.resolving = self.resolving, (*self.resolving, alias)
                out = self.value(self.aliases[alias])
                self.resolving = before
                return out
            raise QueryError(f"column {S.shown(c)} does not exist")
        inner, kind = found[0], E.kind_of(found[1])
        if self.grouped and inner not in self.groups:
            if not (self.compat and self.order_key):
                raise QueryError(f"column {S.shown(c)} must be grouped or aggregated")
            return E.Value(self.result(F.min_by(quoted(inner), F.struct(*map(quoted, self.order_key))), f"first {inner}"), kind)
        return E.Value(quoted(inner), kind, whole=isinstance(found[1], T.IntegralType))

    def result(self, aggregation: Column, what: str) -> Column:
        self.results.setdefault(what, aggregation)
        return quoted(what)

    def aggregate(self, a: S.Aggregate) -> E.Value:
        if not self.grouped:
            raise QueryError(f"aggregate {S.shown(a)} is not allowed here")
        what = f"agg {S.shown(a)}"
        if a.of is None:
            return E.Value(self.result(F.count(F.lit(1)), what), "number", never_null=True)
        inner = Scope(self.relations, self.compat)
        of = inner.value(a.of)
        column, kind = R.aggregation(a.name, of, a.distinct, self.compat)
        return E.Value(self.result(column, what), kind, never_null=a.name == "count")

    def value(self, e: S.Expr) -> E.Value:
        compat = self.compat
        match e:
            case S.Literal(v):
                return E.literal(v)
            case S.Column():
                return self.column(e)
            case S.Aggregate():
                return self.aggregate(e)
            case S.Unary("-", of):
                return E.negative(self.value(of), compat)
            case S.Unary(_, of):
                return E.negation(self.value(of), compat)
            case S.Binary(op, left, right):
                a, b = self.value(left), self.value(right)
                if op in ("and", "or"):
                    return E.both(op, a, b, compat)
                if op == "like":
                    return E.like(a, b, compat)
                if op in ("+", "-", "*", "/"):
                    return E.arithmetic(op, a, b, compat)
                return E.compare(op, a, b, compat)
            case S.In(of, items, negated):
                return E.one_of(self.value(of), [self.value(i) for i in items], negated, compat)
            case S.Between(of, low, high, negated):
                v = self.value(of)
                inside = E.both("and", E.compare(">=", v, self.value(low), compat), E.compare("<=", v, self.value(high), compat), compat)
                return E.negation(inside, compat) if negated else inside
            case S.IsNull(of, negated):
                column = self.value(of).column
                return E.Value(column.isNotNull() if negated else column.isNull(), "truth", never_null=True)
        raise QueryError(f"{S.shown(e)} is not allowed here")

    def condition(self, e: S.Expr) -> Column:
        return E.truth(self.value(e), self.compat)


Lookup = Callable[[str], Table]


def source(select: S.Select, lookup: Lookup, compat: bool, spark: SparkSession) -> tuple[DataFrame, Scope]:
    """The joined relations, in the written order."""
    if select.relation is None:
        return spark.range(1).select(), Scope([], compat)
    df, bound = bind(lookup(select.relation.name), select.relation.alias, 0)
    scope = Scope([bound], compat)
    for i, j in enumerate(select.joins, 1):
        if any(b.alias.lower() == j.relation.alias.lower() for b in scope.relations):
            raise QueryError(f"{j.relation.alias} names two relations")
        right, bound = bind(lookup(j.relation.name), j.relation.alias, i)
        scope.relations.append(bound)
        df = R.join(df, right, scope.condition(j.on), j.kind)
    return df, scope


def compile_select(select: S.Select, lookup: Lookup, compat: bool, spark: SparkSession) -> DataFrame:
    df, scope = source(select, lookup, compat, spark)
    if select.where is not None:
        df = R.where(df, scope.condition(select.where))
    items = expand(select, scope)
    aliases = {i.alias.lower(): i.value for i in items if i.alias}
    used = [i.value for i in items] + [k.value for k in select.order]
    grouped = bool(select.group) or any(map(S.aggregates, used))
    if select.having is not None and not grouped and not S.aggregates(select.having):
        raise QueryError("HAVING needs GROUP BY or an aggregate")
    if grouped or select.having is not None:
        if any(isinstance(i.value, S.Star) for i in select.items):
            raise QueryError("* is not allowed with GROUP BY or aggregates")
        groups = {}
        for c in select.group:
            found = scope.locate(c)
            if found is None:
                raise QueryError(f"column {S.shown(c)} does not exist")
            groups[found[0]] = found[1]
        scope = Scope(scope.relations, compat, True, groups, order_key=tuple(b.key for b in scope.relations) if all(b.key for b in scope.relations) else ())
    values = [scope.value(i.value) for i in items]
    scope.aliases = aliases
    having = scope.condition(select.having) if select.having is not None else None
    keys = [(sort_position(k.value, items), k) for k in select.order]
    sorts = [(f"o{n}" if n is not None else None, None if n is not None else scope.value(k.value), k.descending) for n, k in keys]
    first = ""
    if scope.grouped and compat and scope.groups and scope.order_key and not sorts:
        first = "first row"  # groups come as their first rows do
        scope.result(F.min(F.struct(*map(quoted, scope.order_key))), first)
    if scope.grouped:
        df = R.group(df, [quoted(g) for g in scope.groups], [c.alias(n) for n, c in scope.results.items()])
        if having is not None:
            df = R.where(df, having)
    hidden = [(v.column.alias(f"s{j}"), f"s{j}") for j, (_, v, _) in enumerate(sorts) if v is not None]
    if not sorts and not scope.grouped and (select.limit is not None or select.offset is not None):  # the tables' own order
        own = [b.key for b in scope.relations if b.key]
        hidden = [(quoted(k).alias(f"s{j}"), f"s{j}") for j, k in enumerate(own)]
        sorts = [(name, None, False) for _, name in hidden]
    if first:
        hidden, sorts = [(quoted(first).alias("s0"), "s0")], [("s0", None, False)]
    if select.distinct and hidden:
        if select.order:
            raise QueryError("ORDER BY of DISTINCT rows must name selected columns")
        hidden, sorts = [], [(f"o{n}", None, False) for n in range(len(items))]
    kinds = {f"o{i}": v.kind for i, v in enumerate(values)} | {f"s{j}": v.kind for j, (_, v, _) in enumerate(sorts) if v is not None}
    out = df.select(*[v.column.alias(f"o{i}") for i, v in enumerate(values)], *[c for c, _ in hidden])
    if select.distinct:
        out = R.distinct(out)
    by = [(name or f"s{j}", descending) for j, (name, _, descending) in enumerate(sorts)]
    out = R.ordered(out, [(name, descending, compat and kinds.get(name) == "text") for name, descending in by], select.limit, select.offset)
    out = out.select(*[f"o{i}" for i in range(len(items))])
    return out.toDF(*[i.alias or S.shown(i.value) if not isinstance(i.value, S.Column) else i.alias or i.value.name for i in items])


def expand(select: S.Select, scope: Scope) -> list[S.Item]:
    """The select list with each * written out."""
    out = []
    for i in select.items:
        if not isinstance(i.value, S.Star):
            out.append(i)
            continue
        of = i.value.table
        homes = [r for r in scope.relations if of is None or r.alias.lower() == of.lower()]
        if not homes:
            raise QueryError(f"table {of} is not in the query" if of else "* needs a table")
        out += [S.Item(S.Column(name, r.alias), name) for r in homes for name, _, _ in r.columns]
    return out


def sort_position(e: S.Expr, items: list[S.Item]) -> int | None:
    """Which selected column a sort key means: by alias, by place, or because it is the same expression."""
    if isinstance(e, S.Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
        if not 1 <= e.value <= len(items):
            raise QueryError(f"ORDER BY place {e.value} is not in the select list")
        return e.value - 1
    for n, i in enumerate(items):
        if i.value == e or isinstance(e, S.Column) and e.table is None and (i.alias or "").lower() == e.name.lower():
            return n
    return None


def row_scope(table: Table, compat: bool) -> Scope:
    """A scope over a table's own column names, for UPDATE and DELETE."""
    columns = tuple((f.name, f.name, f.dataType) for f in table.df.schema.fields)
    return Scope([Bound("", columns, table.key)], compat)
