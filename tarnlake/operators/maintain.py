"""Compaction, removal of old versions, and figures."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.sources.catalog import LEASE_S, Catalog, Snapshot, TableInfo, file_name

#: Bytes of Parquet that compaction puts in a file.
FILE_BYTES = 256 << 20


def files_for(catalog: Catalog, table: TableInfo) -> int:
    return max(1, round(sum(catalog.folder.size("data", *p.split("/")) for p in table.parts) / FILE_BYTES))


def laid_out(catalog: Catalog, table: TableInfo, snapshot: Snapshot) -> tuple[DataFrame, dict[str, str]]:
    """The table in files of about FILE_BYTES, ranged and sorted by its key, and bloom filters for the indexed columns, so that scans by either skip files and row groups."""
    df = catalog.read(table)
    files = files_for(catalog, table)
    if table.key:
        df = df.repartitionByRange(files, table.key).sortWithinPartitions(table.key)
    else:
        df = df.coalesce(files)
    columns = sorted({c for i in snapshot.indexes.values() if i.table == table.name.lower() for c in i.columns} | ({table.key} if table.key else set()))
    return df, {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def compact(catalog: Catalog, snapshot: Snapshot) -> tuple[Snapshot, int, int]:
    """(snapshot, tables rewritten, parts replaced): tables of more files than their bytes ask for are laid out anew."""
    done = parts = 0
    for table in snapshot.tables.values():
        if len(table.parts) <= files_for(catalog, table):
            continue
        written = catalog.write(table, *laid_out(catalog, table, snapshot))
        done, parts = done + 1, parts + len(table.parts)
        snapshot = snapshot.with_table(replace(table, parts=written))
    return snapshot, done, parts


def collect_garbage(catalog: Catalog, keep: int = 5) -> tuple[int, int]:
    """(versions, folders) removed: all but the newest keep versions and those that transactions read, and folders of which neither they nor a writer need a file."""
    keep = keep if keep > 0 else 5
    held = [n for n in catalog.folder.names("data")]  # listed before the leases, so that none written since can be missed
    leases = set(catalog.leases())
    versions = catalog.versions()
    read = {int(n[1:].split("-")[0]) for n in leases if re.match(r"v\d+-", n)}
    kept = [v for k, v in enumerate(versions) if k >= len(versions) - keep or v in read]
    alive = {p.split("/")[0] for v in kept for t in catalog.load(v).tables.values() for p in t.parts} | leases
    for v in set(versions) - set(kept):
        catalog.folder.delete("_meta", file_name(v))
    dead = [p for p in held if p not in alive] if kept else []
    for p in dead:
        catalog.folder.delete("data", p)
    for n in set(catalog.folder.names("_leases")) - leases:
        if catalog.folder.exists("_leases", n) and catalog.folder.age("_leases", n) >= LEASE_S:
            catalog.release(n)
    return len(versions) - len(kept), len(dead)


def estimate_distinct(df: DataFrame, *columns: str) -> int:
    """About how many distinct values the columns have together, by a sketch in one pass."""
    return df.agg(F.approx_count_distinct(F.struct(*columns)).alias("n")).first()["n"]


def stats(catalog: Catalog, snapshot: Snapshot) -> dict:
    tables = snapshot.tables.values()
    return {
        "version": snapshot.version,
        "versions": len(catalog.versions()),
        "num_tables": len(tables),
        "num_indexes": len(snapshot.indexes),
        "num_parts": sum(len(t.parts) for t in tables),
        "rows": sum(t.rows for t in tables),
        "bytes": sum(catalog.folder.size("data", *p.split("/")) for t in tables for p in t.parts),
        **catalog.counters,
    }
