"""Row changes as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of rows with one key, that with the largest ordinal; the ordinal is dropped."""
    names = [c for c in rows.columns if c != ordinal]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), ordinal).alias("row"))
    return last.select("row.*").select(*names)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def update(df: DataFrame, changes: dict[str, Column], condition: Column) -> DataFrame:
    """All changes see the row as it was."""
    hit = F.coalesce(condition, F.lit(False))
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.when(hit, changes[c].cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in df.columns])


def delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))
