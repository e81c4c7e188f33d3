"""The dialect's statements and expressions as frozen values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    value: str | int | float | bool | None


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  #: "-" or "not"
    of: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In:
    of: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    of: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    of: Expr
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    of: Expr | None  #: None: all rows
    distinct: bool = False


Expr = Literal | Column | Star | Unary | Binary | In | Between | IsNull | Aggregate


@dataclass(frozen=True)
class Item:
    value: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Relation:
    name: str
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  #: inner, left or right
    relation: Relation
    on: Expr


@dataclass(frozen=True)
class SortKey:
    value: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    relation: Relation | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Column, ...] = ()
    having: Expr | None = None
    order: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  #: int, float, text or blob
    nullable: bool = True
    key: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    lenient: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    lenient: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    lenient: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str
    lenient: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Transaction:
    kind: str  #: begin, commit or rollback


Statement = Select | Insert | Update | Delete | CreateTable | CreateIndex | DropTable | DropIndex | Transaction


def shown(e: Expr) -> str:
    """An expression as the name of an output column."""
    match e:
        case Literal(None):
            return "NULL"
        case Literal(bool() as v):
            return str(v).lower()
        case Literal(v):
            return str(v)
        case Column(name, table):
            return f"{table}.{name}" if table else name
        case Star(table):
            return f"{table}.*" if table else "*"
        case Unary(op, of):
            return f"({op.upper()} {shown(of)})" if op == "not" else f"({op}{shown(of)})"
        case Binary(op, left, right):
            return f"({shown(left)} {op.upper()} {shown(right)})"
        case In(of, items, negated):
            return f"{shown(of)}{' NOT' if negated else ''} IN ({', '.join(map(shown, items))})"
        case Between(of, low, high, negated):
            return f"{shown(of)}{' NOT' if negated else ''} BETWEEN {shown(low)} AND {shown(high)}"
        case IsNull(of, negated):
            return f"{shown(of)} IS {'NOT ' if negated else ''}NULL"
        case Aggregate(name, of, distinct):
            return f"{name}({'DISTINCT ' if distinct else ''}{'*' if of is None else shown(of)})"
    raise TypeError(e)


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Unary(_, of) | IsNull(of):
            return (of,)
        case Binary(_, left, right):
            return left, right
        case In(of, items):
            return of, *items
        case Between(of, low, high):
            return of, low, high
        case Aggregate(_, of) if of is not None:
            return (of,)
    return ()


def aggregates(e: Expr) -> bool:
    return isinstance(e, Aggregate) or any(map(aggregates, children(e)))
