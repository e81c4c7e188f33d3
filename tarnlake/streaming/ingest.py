"""Upserts a stream into a table of the engine, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.engine import Engine
from tarnlake.errors import QueryError
from tarnlake.operators.changes import last_by_key


def upsert_stream(stream: DataFrame, engine: Engine, table: str, order: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Of the rows of one key in a micro-batch, that with the largest `order` column wins. The table must have a key, so a batch that is run again gives the same table, and a restart neither loses nor doubles rows; a null key ends the stream with an error."""
    key = engine.table_info(table).key
    if key is None:
        raise QueryError(f"table {table} has no key to upsert by")

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("__order", F.col(order))
        engine.session.upsert(table, last_by_key(rows, key, "__order"))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
