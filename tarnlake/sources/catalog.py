"""Versioned snapshots of a database: one immutable JSON file for each version, over immutable Parquet folders.

A version is published by creating its file, which fails if another writer was first; the newest file is the current
version. A snapshot that can't be read is an error, never an empty database. A table's parts are its Parquet files, so a
change rewrites only files that hold rows it hits.

What no version names yet is protected by leases, small files under _leases: one for each folder from before it is written
until a version that names it is published, and one for each version that a transaction reads. Garbage collection keeps
what has a lease younger than LEASE_S, and a version whose files aren't all there is never published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnlake.errors import ConflictError, EngineError
from tarnlake.plans.syntax import ColumnDef
from tarnlake.sources.files import Folder

#: Seconds after which a lease of a writer that has died no longer counts.
LEASE_S = 24 * 3600
TYPES = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[ColumnDef, ...]
    parts: tuple[str, ...] = ()  #: Parquet files under data, as folder/file
    rows: int = 0

    @property
    def key(self) -> str | None:
        """The declared key; only the first one counts."""
        return next((c.name for c in self.columns if c.key), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], True, {"key": True} if c.name == self.key else {}) for c in self.columns])

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None) or next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class IndexInfo:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    tables: dict[str, TableInfo] = field(default_factory=dict)
    indexes: dict[str, IndexInfo] = field(default_factory=dict)

    def with_table(self, t: TableInfo) -> Snapshot:
        return replace(self, tables=self.tables | {t.name.lower(): t})

    def without_table(self, name: str) -> Snapshot:
        name = name.lower()
        return replace(self, tables={k: v for k, v in self.tables.items() if k != name}, indexes={k: v for k, v in self.indexes.items() if v.table != name})

    def with_index(self, i: IndexInfo) -> Snapshot:
        return replace(self, indexes=self.indexes | {i.name.lower(): i})

    def without_index(self, name: str) -> Snapshot:
        return replace(self, indexes={k: v for k, v in self.indexes.items() if k != name.lower()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        raw = json.loads(text)
        tables = {k: TableInfo(t["name"], tuple(ColumnDef(**c) for c in t["columns"]), tuple(t["parts"]), t["rows"]) for k, t in raw["tables"].items()}
        indexes = {k: IndexInfo(i["name"], i["table"], tuple(i["columns"]), i["unique"]) for k, i in raw["indexes"].items()}
        return cls(raw["version"], tables, indexes)


def file_name(version: int) -> str:
    return f"v{version:010d}.json"


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.folder = spark, Folder(spark, root)
        self.counters = dict.fromkeys(("files_read", "files_written", "versions_read", "versions_published"), 0)

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.folder.names("_meta") if n.startswith("v") and n.endswith(".json")]

    def load(self, version: int | None = None) -> Snapshot:
        """A version, or the current one; an empty snapshot only where there is none at all."""
        if version is None:
            known = self.versions()
            if not known:
                return Snapshot()
            version = known[-1]
        if not self.folder.exists("_meta", file_name(version)):
            raise EngineError(f"version {version} does not exist")
        self.counters["versions_read"] += 1
        try:
            return Snapshot.from_json(self.folder.read("_meta", file_name(version)))
        except (ValueError, KeyError, TypeError) as e:
            raise EngineError(f"version {version} can't be read: {e}") from e

    def publish(self, base: Snapshot, staged: Snapshot) -> Snapshot:
        """Makes staged, which began as base, the next version. If others have published since, their changes of other tables and indexes are kept; of the same ones, it is a conflict."""
        added = {p for t in staged.tables.values() for p in t.parts} - {p for t in base.tables.values() for p in t.parts}
        if gone := [p for p in sorted(added) if not self.folder.exists("data", *p.split("/"))]:
            raise ConflictError(f"{gone[0]} has been removed; nothing is published")
        while True:
            now = self.load()
            merged = replace(staged, version=now.version + 1)
            if now.version != base.version:
                merged = replace(merged, tables=merge(base.tables, staged.tables, now.tables), indexes=merge(base.indexes, staged.indexes, now.indexes))
            if self.folder.create(merged.to_json(), "_meta", file_name(merged.version)):
                self.counters["versions_published"] += 1
                for folder in {p.split("/")[0] for p in added}:
                    self.release(folder)
                return merged

    def lease(self, name: str) -> str:
        self.folder.create("", "_leases", name)
        return name

    def release(self, name: str) -> None:
        self.folder.delete("_leases", name)

    def leases(self) -> list[str]:
        """Of folders and, as vN-…, of versions; those too old don't count."""
        return [n for n in self.folder.names("_leases") if self.folder.age("_leases", n) < LEASE_S]

    def discard(self, parts: set[str]) -> None:
        """Removes what was staged and will not be published."""
        for folder in {p.split("/")[0] for p in parts}:
            self.folder.delete("data", folder)
            self.release(folder)

    def read(self, table: TableInfo, parts: tuple[str, ...] | None = None) -> DataFrame:
        parts = table.parts if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], table.schema())
        self.counters["files_read"] += len(parts)
        return self.spark.read.schema(table.schema()).parquet(*[self.folder.at("data", p) for p in parts])

    def write(self, table: TableInfo, df: DataFrame, options: dict[str, str] | None = None) -> tuple[str, ...]:
        """New parts of the table; always in a new folder, so no reader loses what it reads."""
        folder = self.lease(f"{table.name.lower()}-{uuid.uuid4().hex}")
        df.write.options(**(options or {})).parquet(self.folder.at("data", folder))
        parts = tuple(f"{folder}/{n}" for n in self.folder.names("data", folder) if n.endswith(".parquet"))
        self.counters["files_written"] += len(parts)
        return parts


def merge(base: dict, staged: dict, now: dict) -> dict:
    out = dict(now)
    for k in {*base, *staged}:
        if base.get(k) == staged.get(k):
            continue
        if now.get(k) != base.get(k):
            raise ConflictError(f"{k} has been changed by another writer")
        if k in staged:
            out[k] = staged[k]
        else:
            out.pop(k, None)
    return out
