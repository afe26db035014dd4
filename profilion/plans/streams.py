"""Queries that run as streams, over the driver's tables in micro-batches, and that read files through the data sources. Names as in
``plans.catalog``; each stream is played in pieces, out of order where it may be, and must give what one batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.operators import temporal, track
from profilion.plans.catalog import EVENTS, GATES, HOUR, events, neat, query, table
from profilion.session import shared_folder
from profilion.sources import datasource, gridded, messages
from profilion.sources.store import Table
from profilion.streaming import ingest, tracks, windows

SIX = 6 * HOUR


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def played(parts: list[DataFrame], start) -> None:
    """Writes parts to a folder one after the other, and after each runs the stream of the folder on from its checkpoint.

    start: from a stream and a folder for checkpoints to a query that takes what there is and ends."""
    spark = parts[0].sparkSession
    source, checkpoint = _folder(spark), _folder(spark)
    for part in parts:
        part.write.mode("append").parquet(source)
        start(spark.readStream.schema(part.schema).parquet(source), checkpoint).awaitTermination()


def sunk(rows: DataFrame, checkpoint: str, path: str):
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


# -- the store


@query(f"WITH {EVENTS} SELECT CAST(user_id % 2 AS BIGINT) AS site, t // 60000000 * 60000000 AS t, min(event_id) AS value FROM ev GROUP BY ALL")
def store_stream(spark, sf_dir):
    """Three thirds of the rows, the last one first and once more at the end, as micro-batches: what one write of all gives."""
    rows = events(spark, sf_dir).select((F.col("user_id") % 2).cast("long").alias("site"), (F.floor(F.col("t") / 60_000_000) * 60_000_000).alias("t"), F.col("event_id").alias("value"))
    third = F.pmod(F.xxhash64("t", "site"), F.lit(3))
    late, first, rest = (rows.where(third == k) for k in (2, 0, 1))
    kept = Table(spark, _folder(spark), SIX, ["site", "t"], ["site"])
    played([late, first, late, rest], lambda stream, checkpoint: ingest.ingest(stream, kept, checkpoint, delay="3650 days"))
    return kept.rows().select(F.col("site").cast("long").alias("site"), "t", "value")


@query(f"WITH {EVENTS}, l AS (SELECT max(t) AS m FROM ev) SELECT t // {SIX} * {SIX} AS bucket, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM (SELECT DISTINCT t FROM ev), l WHERE t >= m - {72 * HOUR} GROUP BY ALL")
def store_stream_retention(spark, sf_dir):
    """The retention at work while a stream is written: what is older than 72 hours before the latest row goes after each batch."""
    rows = events(spark, sf_dir).groupBy("t").agg(F.min("event_id").alias("value"))
    middle = (rows.agg(F.min("t"), F.max("t")).first()[0] or 0) + 30 * 24 * HOUR
    kept = Table(spark, _folder(spark), SIX, ["t"])
    played([rows.where(F.col("t") < middle), rows.where(F.col("t") >= middle)], lambda stream, checkpoint: ingest.ingest(stream, kept, checkpoint, delay="3650 days", keep=72 * HOUR))
    return kept.rows().groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


# -- event time


def _closed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows, and a last one far ahead, of no type, which moves the watermark past all others."""
    return rows.unionByName(rows.agg((F.max("t") + 400 * 24 * HOUR).alias("t")).where("t IS NOT NULL"), allowMissingColumns=True)


@query(f"WITH {EVENTS} SELECT event_type, t // {SIX} * {SIX} AS bucket, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ev GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    rows = events(spark, sf_dir).select("t", "event_type", "event_id")
    even = F.col("event_id") % 2 == 0
    out = _folder(spark)
    found = lambda stream: windows.tumbling(stream, ["event_type"], "t", "6 hours", "300 days", F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    played([rows.where(~even), _closed(spark, rows.where(even))], lambda stream, checkpoint: sunk(found(stream), checkpoint, out))
    return spark.read.parquet(out).where("event_type IS NOT NULL").select("event_type", F.col("from").alias("bucket"), "n", "ids")


@query(f"""WITH {EVENTS}, o AS (SELECT *, coalesce(t - lag(t) OVER w > {24 * HOUR}, false)::INT AS o FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(t) AS "from", max(t) AS "to", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    rows = events(spark, sf_dir).select("t", "user_id", "event_id")
    even = F.col("event_id") % 2 == 0
    out = _folder(spark)
    found = lambda stream: windows.sessions(stream, ["user_id"], "t", "24 hours", "300 days", F.count("*").alias("n"))
    played([rows.where(even), _closed(spark, rows.where(~even))], lambda stream, checkpoint: sunk(found(stream), checkpoint, out))
    return spark.read.parquet(out).where("user_id IS NOT NULL").select("user_id", "from", "to", "n")


# -- tracks

#: Three detections at a time, 100 apart, that go up or down together by less than that: the cheapest assignment is by order of height,
#: and one that takes the nearest pairs first is wrong wherever they go by more than half of it.
MANY = track.Settings(jump=1e9, gap=12 * 3600.0)
MANY_SQL = f"""{EVENTS}, d AS (SELECT DISTINCT user_id % 20 AS site, t // 60000000 * 60000000 AS t FROM ev),
l AS (SELECT site, t, k * 100.0::DOUBLE + t // 60000000 * 37 % 100 AS base FROM d, range(3) r(k)),
o AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY site ORDER BY t, base) > {12 * HOUR}, false)::INT AS o, row_number() OVER (PARTITION BY site, t ORDER BY base) - 1 AS k FROM l),
s AS (SELECT *, sum(o) OVER (PARTITION BY site ORDER BY t, base ROWS UNBOUNDED PRECEDING) AS n FROM o)"""


def _threes(spark, sf_dir) -> DataFrame:
    d = events(spark, sf_dir).select((F.col("user_id") % 20).alias("site"), (F.floor(F.col("t") / 60_000_000) * 60_000_000).alias("t")).distinct()
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return d.select("site", "t", F.lit("haze").alias("type"), (F.col("k") * 100.0 + F.floor(F.col("t") / 60_000_000) * 37 % 100).alias("base"), F.lit(None).cast("double").alias("top"))


@query(f"WITH {MANY_SQL} SELECT site, t, round(base, 6) + 0.0 AS base, concat_ws(':', site, 'haze', min(t) OVER (PARTITION BY site, n), k) AS track FROM s")
def tracks_many(spark, sf_dir):
    """Three layers at a time: assignment has a choice, and a nearest-first one would be wrong."""
    found = track.assigned(_threes(spark, sf_dir), MANY)
    return found.select("site", "t", neat("base").alias("base"), "track")


@query(f"WITH {MANY_SQL} SELECT site, t, round(base, 6) + 0.0 AS base, concat_ws(':', site, 'haze', min(t) OVER (PARTITION BY site, n), k) AS track FROM s")
def tracks_stream(spark, sf_dir):
    """The same layers as a stream of two micro-batches, mixed in time: tracks are kept as state between them."""
    rows = _threes(spark, sf_dir).withColumn("t", F.col("t").cast("long"))
    early = F.pmod(F.xxhash64("t"), F.lit(2)) == 0
    out = _folder(spark)
    played([rows.where(early), _closed(spark, rows.where(~early))], lambda stream, checkpoint: sunk(tracks.tracked(stream, "300 days", MANY), checkpoint, out))
    return spark.read.parquet(out).select("site", "t", neat("base").alias("base"), "track")


# -- intervals

SPANS = """l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS k, epoch_us(l_shipdate::TIMESTAMP) // 86400000000 AS lo, epoch_us(l_shipdate::TIMESTAMP) // 86400000000 + l_linenumber * 9 AS hi FROM lineitem),
o AS (SELECT o_orderkey, o_custkey AS k, epoch_us(o_orderdate::TIMESTAMP) // 86400000000 AS lo2, epoch_us(o_orderdate::TIMESTAMP) // 86400000000 + o_orderkey % 128 AS hi2 FROM orders)"""


@query(f"WITH {SPANS} SELECT l_orderkey, l_linenumber, o_orderkey, least(hi, hi2) - greatest(lo, lo2) + 1 AS days FROM l JOIN o USING (k) WHERE lo <= hi2 AND lo2 <= hi")
def interval_overlap(spark, sf_dir):
    """Shipments of a supplier that are under way, for 10 to 64 days, while orders of the customer of the same number are open, for 0 to 127 days."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), day("l_shipdate").alias("lo"), (day("l_shipdate") + F.col("l_linenumber") * 9).alias("hi"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), day("o_orderdate").alias("lo2"), (day("o_orderdate") + F.col("o_orderkey") % 128).alias("hi2"))
    pairs = temporal.overlapping(lines, orders, ["k"], "lo", "hi", "lo2", "hi2")
    return pairs.select("l_orderkey", "l_linenumber", "o_orderkey", (F.least("hi", "hi2") - F.greatest("lo", "lo2") + 1).alias("days"))


# -- files through data sources

MINUTE = 60_000_000
STARTS = 1_767_225_600_000_000


@query(f"""WITH {GATES} SELECT 'messages' AS source, {STARTS} + vec_id * {MINUTE} AS t, gate, round(round_even(v / 1e-5::DOUBLE, 0) * 1e-5::DOUBLE, 6) + 0.0 AS v FROM e WHERE vec_id BETWEEN 20 AND 300
UNION ALL SELECT 'gridded', {STARTS} + vec_id * {MINUTE}, gate, round(format('{{:.6e}}', v)::DOUBLE, 8) + 0.0 FROM e WHERE vec_id BETWEEN 20 AND 300""")
def read_by_format(spark, sf_dir):
    """Vectors written as logged messages and as gridded text, read through ``spark.read.format`` and SQL with a bound on time."""
    datasource.register(spark)
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * MINUTE + STARTS).alias("t"), F.col("embedding").cast("array<double>").alias("beta"))
    rows = rows.withColumn("r", F.transform("beta", lambda _b, i: i * 10.0 + 5.0))
    logs, grids = _folder(spark), _folder(spark)
    messages.write(rows, logs, unit=1e-5)
    ranges = rows.select("r").first()
    gridded.write(rows, grids, list(ranges["r"]) if ranges else [5.0])
    within = F.col("t").between(STARTS + 20 * MINUTE, STARTS + 300 * MINUTE)
    logged = spark.read.format("profilion_messages").schema("t long, beta array<double>").option("unit", "1e-5").option("range_bytes", 100_000).load(logs).where(within)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW profilion_grids USING profilion_grid OPTIONS (path '{grids}', range_bytes '100000')")
    spread = lambda df, name, digits: df.select(F.lit(name).alias("source"), "t", F.posexplode("beta").alias("gate", "v")).select("source", "t", F.col("gate").cast("long").alias("gate"), neat("v", digits).alias("v"))
    return spread(logged, "messages", 6).unionByName(spread(spark.table("profilion_grids").where(within), "gridded", 8))
