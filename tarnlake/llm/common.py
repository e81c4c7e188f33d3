"""Helpers that the training-data operators share: scratch tables, text buffers, missing columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one serves if all run on this machine; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarnlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that store() wrote and no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Adds the named columns as nulls where df lacks them."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c.lower() not in have})


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        at = f"__{name}"
        while at.lower() in have:
            at += "_"
        have.add(at.lower())
        out.append(at)
    return out


def remainder(key: str | F.Column, modulus: int = 5) -> F.Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def strings(col: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column's texts, null as empty."""
    return [x or "" for x in col.to_pylist()]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes in one array without copies of single texts, and n + 1 offsets; null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int, rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) whose bytes and number stay within limits, or single longer rows."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(a + rows, max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1))
        yield a, b
        a = b


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
