"""A stream of rows into a table of the store: late, out of order and again, with what one batch write gives in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from profilion.sources.store import Table


def ingest(rows: DataFrame, table: Table, checkpoint: str, delay: str = "1 hour", keep: int | None = None, order: list[Column] | None = None, continuous: str | None = None) -> StreamingQuery:
    """Starts a query that merges a stream of rows (t in microseconds) into the table's buckets.

    Streams begin at a watermark of 1970, so no row may be that old. A row that has come before, within ``delay`` of the latest row, is dropped before it is merged; a row later than that is dropped
    as well. Of different rows with equal keys the first in ``order`` stays, whichever came first. keep: retention in microseconds,
    counted back from the latest row stored; older buckets go after each batch. A batch that is run again after a failure changes
    nothing. continuous: the trigger's interval; without it, all that there is is taken and the query ends."""
    timed = rows.withColumn("_at", F.timestamp_micros("t")).withWatermark("_at", delay)
    fresh = timed.withColumn("_same", F.xxhash64(*rows.columns)).dropDuplicatesWithinWatermark([*table.keys, "_same"]).drop("_at", "_same")

    def merged(batch: DataFrame, _number: int) -> None:
        table.merge(batch, order)
        if keep is not None and (stored := table.rows()) is not None:
            table.purge(stored.agg(F.max("t")).first()[0] - keep)

    query = fresh.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=continuous) if continuous else query.trigger(availableNow=True)).start()
