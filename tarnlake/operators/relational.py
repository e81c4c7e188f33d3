"""The relational operators as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.semantics import Value, as_number, sort_key


def key_range(df: DataFrame, key: str, low: object = None, high: object = None) -> DataFrame:
    """Rows with low <= key < high; None leaves a side open. Both reach the scan as Parquet filters."""
    if low is not None:
        df = df.where(F.col(key) >= low)
    return df if high is None else df.where(F.col(key) < high)


def point_get(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def join(left: DataFrame, right: DataFrame, on: Column, kind: str) -> DataFrame:
    """Catalyst and AQE pick the algorithm; equalities of either mode are hash keys."""
    return left.join(right, on, kind)


def aggregation(name: str, of: Value, distinct: bool, compat: bool) -> tuple[Column, str]:
    """An aggregate with the kind of its result; compat sums and averages what is a number among texts."""
    column = of.column
    if name == "count":
        return (F.count_distinct(column) if distinct else F.count(column)), "number"
    if name in ("min", "max"):
        if compat and of.kind == "text":  # by value where texts are numbers
            both = F.when(column.isNotNull(), F.struct(sort_key(of).alias("key"), column.alias("value")))
            return (F.min(both) if name == "min" else F.max(both))["value"], of.kind
        return (F.min(column) if name == "min" else F.max(column)), of.kind
    if of.kind != "number" and compat:
        column = as_number(of)
    if name == "sum":
        return (F.sum_distinct(column) if distinct else F.sum(column)), "number"
    if distinct:
        return F.sum_distinct(column) / F.count_distinct(column), "number"
    return F.avg(column), "number"


def group(df: DataFrame, keys: list[Column], aggregations: list[Column]) -> DataFrame:
    """Without keys there is one group, also of no rows."""
    if not aggregations:
        return df.select(*keys).distinct() if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(*keys).agg(*aggregations) if keys else df.agg(*aggregations)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def ordered(df: DataFrame, keys: list[tuple[str, bool, bool]], limit: int | None, offset: int | None) -> DataFrame:
    """Nulls are lowest: first in rising order, last in falling order. keys: name, whether descending, whether a text in compat's order. A sort with a limit is one top-k step."""
    if keys:
        by = [(sort_key(Value(F.col(k), "text")) if loose else F.col(k), descending) for k, descending, loose in keys]
        df = df.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_first() for c, descending in by])
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
