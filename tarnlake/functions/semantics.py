"""Scalar semantics as Column expressions, in two modes.

ansi: three-valued logic as in SQL. compat: two-valued logic in which NULL is the lowest value and equals NULL, texts
that look like numbers compare as numbers, + joins what isn't numeric, and anything can be a truth value. Where the types
of both sides are known to need no coercion, compat gives the plain expressions, so filters still reach the scan.
Names follow the operators of the syntax tree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that compat reads as numbers; casts alone would also take spaces around them and suffixes.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Texts that are false as truth values.
FALSE_TEXTS = ("", "0", "false")


@dataclass(frozen=True)
class Value:
    """A column with what is known of it."""

    column: Column
    kind: str  #: number, text, truth, null or other
    literal: object = None
    never_null: bool = False
    whole: bool = False  #: of a type of integers


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "truth"
    return "null" if isinstance(t, T.NullType) else "other"


def sort_key(v: Value) -> Column:
    """What values of compat are ordered by: numbers, also those in texts, by value, and other texts by their bytes, before the numbers if they come before the digits. Null for null."""
    x, text = as_number(v), as_text(v)
    rank = F.when(x.isNotNull(), 1).otherwise(F.when(text < "0", 0).otherwise(2))
    return F.when(v.column.isNotNull(), F.struct(rank.alias("rank"), F.coalesce(x, F.lit(0.0)).alias("number"), text.alias("text")))


def literal(v: object) -> Value:
    if v is None:
        return Value(F.lit(None), "null")
    kind = "truth" if isinstance(v, bool) else "text" if isinstance(v, str) else "number"
    return Value(F.lit(v), kind, v, True, kind == "number" and isinstance(v, int))


def as_text(v: Value) -> Column:
    if v.kind == "number":  # whole numbers without a fraction, as texts hold them
        d = v.column.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
        return F.when(whole, v.column.cast("bigint").cast("string")).otherwise(v.column.cast("string"))
    return v.column.cast("string")


def as_number(v: Value) -> Column:
    """The value as double, or null if it is none."""
    if v.kind == "number":
        return v.column.cast("double")
    if v.kind == "text":
        return F.when(v.column.rlike(NUMBER), v.column.try_cast("double"))
    return F.lit(None).cast("double")


def truth(v: Value, compat: bool) -> Column:
    """The value as a condition. In compat it is never null."""
    if not compat:
        return v.column if v.kind in ("truth", "null") else v.column.cast("boolean")
    if v.kind == "truth":
        return F.coalesce(v.column, F.lit(False)) if not v.never_null else v.column
    if v.kind == "number":
        return F.coalesce(v.column != 0, F.lit(False))
    if v.kind == "text":
        return F.coalesce(~v.column.isin(*FALSE_TEXTS), F.lit(False))
    return F.lit(False) if v.kind == "null" else v.column.isNotNull()


def plain(a: Value, b: Value) -> bool:
    """Whether both sides compare without coercion."""
    return a.kind == b.kind and a.kind in ("number", "truth", "other") or {a.kind, b.kind} == {"other", "text"}


def order(a: Value, b: Value) -> tuple[Column, Column]:
    """(a < b, a = b) in compat for sides that are both not null."""
    if plain(a, b):
        return a.column < b.column, a.column == b.column
    x, y = as_number(a), as_number(b)
    s, t = as_text(a), as_text(b)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x < y).otherwise(s < t), F.when(both, x == y).otherwise(s == t)


def compare(op: str, a: Value, b: Value, compat: bool) -> Value:
    if not compat:
        x, y = a.column, b.column
        out = {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()
        return Value(out, "truth")
    if op == ">":
        return compare("<", b, a, True)
    if op == ">=":
        return Value(~compare("<", a, b, True).column, "truth", never_null=True)
    if op == "<=":
        return Value(~compare("<", b, a, True).column, "truth", never_null=True)
    if op == "!=":
        return Value(~compare("=", a, b, True).column, "truth", never_null=True)
    if a.kind == b.kind == "null":
        return Value(F.lit(op == "="), "truth", never_null=True)
    if plain(a, b) and op == "=":  # reaches the scan, and is a hash key of joins
        return Value(a.column.eqNullSafe(b.column), "truth", never_null=True)
    if plain(a, b) and b.never_null:
        return Value(a.column.isNull() | (a.column < b.column), "truth", never_null=True)
    if plain(a, b) and a.never_null:
        return Value(b.column.isNotNull() & (a.column < b.column), "truth", never_null=True)
    less, same = order(a, b)
    if op == "=":
        column = F.when(a.column.isNull() | b.column.isNull(), a.column.isNull() & b.column.isNull()).otherwise(same)
    else:
        column = F.when(a.column.isNull(), b.column.isNotNull()).when(b.column.isNull(), F.lit(False)).otherwise(less)
    return Value(F.coalesce(column, F.lit(False)), "truth", never_null=True)


def like(a: Value, b: Value, compat: bool) -> Value:
    """Ignores case in both modes; % and _ are the only wildcards. In compat a null is an empty text."""
    text = F.coalesce(as_text(a), F.lit("")) if compat else as_text(a)
    if isinstance(b.literal, str):
        return Value(text.ilike(b.literal.replace("\\", "\\\\")), "truth", never_null=compat)
    pattern = F.coalesce(as_text(b), F.lit("")) if compat else as_text(b)
    quoted = F.regexp_replace(F.lower(pattern), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    wild = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit("$"))
    return Value(F.rlike(F.lower(text), wild), "truth", never_null=compat)


def add(a: Value, b: Value, compat: bool) -> Value:
    numbers = {a.kind, b.kind} <= {"number", "null"}
    if numbers and not (compat and "null" in (a.kind, b.kind)):
        if not compat:
            return Value(a.column + b.column, "number")
        # a null beside a number would be an empty text joined to it, which a column of numbers can't hold: it stays null
        return Value(a.column + b.column, "number", never_null=a.never_null and b.never_null)
    if not compat:
        return Value(F.concat(as_text(a), as_text(b)), "text")
    x, y = as_number(a), as_number(b)
    total = as_text(Value(x + y, "number"))
    joined = F.concat(F.coalesce(as_text(a), F.lit("")), F.coalesce(as_text(b), F.lit("")))
    return Value(F.when(x.isNotNull() & y.isNotNull(), total).otherwise(joined), "text", never_null=True)


def arithmetic(op: str, a: Value, b: Value, compat: bool) -> Value:
    if a.whole and b.whole and op != "/":  # integers have 64 bits, whatever the scan's type
        a, b = (replace(v, column=v.column.cast("bigint")) for v in (a, b))
        return replace(arithmetic(op, replace(a, whole=False), replace(b, whole=False), compat), whole=True)
    if op == "+":
        return add(a, b, compat)
    if op == "/":
        x, y = (as_number(v) if compat else v.column.cast("double") for v in (a, b))
        if compat:
            x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        return Value(F.try_divide(x, y), "number")
    if compat and not (a.kind == b.kind == "number" and a.never_null and b.never_null):
        x, y = (F.coalesce(v.column, F.lit(0)) if v.kind == "number" else F.coalesce(as_number(v), F.lit(0.0)) for v in (a, b))
        return Value(x - y if op == "-" else x * y, "number", never_null=True)
    return Value(a.column - b.column if op == "-" else a.column * b.column, "number")


def negative(a: Value, compat: bool) -> Value:
    if a.literal is not None and a.kind == "number":
        return literal(-a.literal)
    return Value(-a.column if a.kind == "number" else -as_number(a) if compat else -a.column, "number")


def negation(a: Value, compat: bool) -> Value:
    return Value(~truth(a, compat), "truth", never_null=compat)


def both(op: str, a: Value, b: Value, compat: bool) -> Value:
    x, y = truth(a, compat), truth(b, compat)
    return Value(x & y if op == "and" else x | y, "truth", never_null=compat)


def one_of(a: Value, items: list[Value], negated: bool, compat: bool) -> Value:
    if not compat:
        column = a.column.isin(*[i.literal for i in items]) if all(i.literal is not None for i in items) else a.column.isin(*[i.column for i in items])
        return Value(~column if negated else column, "truth")
    if all(plain(a, i) and i.literal is not None for i in items):
        column = a.column.isNotNull() & a.column.isin(*[i.literal for i in items])
    else:
        column = F.lit(False)
        for i in items:
            column = column | compare("=", a, i, True).column
    return Value(~column if negated else column, "truth", never_null=True)
