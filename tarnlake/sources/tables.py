"""Parquet tables of a folder as read-only relations, and scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tarnlake.errors import EngineError
from tarnlake.plans.compiler import Table

#: The unique column of each table that has one.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}


def parquet_lookup(spark: SparkSession, folder: str) -> Callable[[str], Table]:
    return lambda name: Table(spark.read.parquet(f"{folder}/{name.lower()}.parquet"), KEYS.get(name.lower()))


def scratch_root(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, in spark.checkpoint.dir where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tarnlake-")
    return f"{base.rstrip('/')}/database-{uuid.uuid4().hex}"
