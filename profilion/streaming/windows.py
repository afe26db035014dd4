"""Aggregates by event time on a stream: buckets and sessions, given out once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """Rows with their time (microseconds in ``at``) as an event time; rows later than ``delay`` are dropped by what follows."""
    return rows.withColumn("_at", F.timestamp_micros(at)).withWatermark("_at", delay)


def tumbling(rows: DataFrame, keys: list[str], at: str, width: str, delay: str, *totals: Column) -> DataFrame:
    """(keys, from, totals) of each bucket of time, from in microseconds."""
    found = timed(rows, at, delay).groupBy(*keys, F.window("_at", width).alias("_w")).agg(*totals)
    return found.withColumn("from", F.unix_micros("_w.start")).drop("_w")


def sessions(rows: DataFrame, keys: list[str], at: str, gap: str, delay: str, *totals: Column) -> DataFrame:
    """(keys, from, to, totals) of each session: from its first row on, to its last."""
    found = timed(rows, at, delay).groupBy(*keys, F.session_window("_at", gap).alias("_w")).agg(F.max(at).alias("to"), *totals)
    return found.withColumn("from", F.unix_micros("_w.start")).drop("_w")
