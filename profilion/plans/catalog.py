"""Every query of the base library, by name: QUERIES, and ORACLES with the SQL of those SQL can express.

Rows of ``embeddings`` stand for profiles (gate = place in the array), ``events`` for series over time, and
``event_type`` for layer type or quality bit. Doubles are rounded and freed of negative zeros on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import aggregates, blocks, frames, layers, preprocess, temporal
from profilion.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
GATES = "e AS (SELECT vec_id, unnest(range(len(embedding))) AS gate, unnest(embedding)::DOUBLE AS v FROM embeddings)"
EVENTS = "ev AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, props FROM events)"
BITS = {"view": 1, "click": 2, "purchase": 4, "signup": 32, "error": 128}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.unroll(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", temporal.micros("ts").alias("t"), "user_id", "event_type", "value", "props")


def neat(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def bit(type_column: str = "event_type"):
    out = F.lit(0)
    for name, b in BITS.items():
        out = F.when(F.col(type_column) == name, b).otherwise(out)
    return out.cast("long")


BIT_SQL = "CAST(CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BITS.items()) + " ELSE 0 END AS BIGINT)"


# -- neighbourhoods


def _haar_sql(n: int) -> str:
    lo, hi = f"(PARTITION BY vec_id ORDER BY gate ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", f"(PARTITION BY vec_id ORDER BY gate ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"SELECT vec_id, gate, {n} AS n, CASE WHEN count(v) OVER {lo} = {n} AND count(v) OVER {hi} = {n} THEN (sum(v) OVER {lo} / {n}.0::DOUBLE - sum(v) OVER {hi} / {n}.0::DOUBLE) / 2.0::DOUBLE END AS w FROM e"


@query(f"WITH {GATES}, h AS ({_haar_sql(4)}) SELECT vec_id, gate, round(w, 6) + 0.0 AS w FROM h WHERE w IS NOT NULL")
def haar_covariance(spark, sf_dir):
    return frames.haar(gates(spark, sf_dir), "vec_id", "gate", "v", 4).where("w IS NOT NULL").select("vec_id", F.col("gate").cast("long").alias("gate"), neat("w").alias("w"))


@query(f"""WITH {GATES}, h AS (SELECT vec_id, gate, sqrt(sum(v * v) OVER w) / 8.0::DOUBLE AS noise, count(v) OVER w AS c FROM e
WINDOW w AS (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING))
SELECT vec_id, gate, round(noise, 6) + 0.0 AS noise FROM h WHERE c = 8""")
def haar_noise(spark, sf_dir):
    return frames.haar_noise(gates(spark, sf_dir), "vec_id", "gate", "v", 4).where("noise IS NOT NULL").select("vec_id", F.col("gate").cast("long").alias("gate"), neat("noise").alias("noise"))


@query(f"WITH {GATES}, h AS ({' UNION ALL '.join(map(_haar_sql, (2, 4, 8)))}) SELECT vec_id, gate, CAST(n AS BIGINT) AS n, round(w, 6) + 0.0 AS w FROM h WHERE w IS NOT NULL")
def haar_multiscale(spark, sf_dir):
    rows = frames.multiscale(gates(spark, sf_dir), "vec_id", "gate", "v", (2, 4, 8)).where("w IS NOT NULL")
    return rows.select("vec_id", F.col("gate").cast("long").alias("gate"), F.col("n").cast("long").alias("n"), neat("w").alias("w"))


@query(f"""WITH {GATES}, n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY gate))
SELECT vec_id, gate, round(v, 6) + 0.0 AS v FROM n WHERE v > b AND v >= a""")
def local_extrema(spark, sf_dir):
    return frames.local_extrema(gates(spark, sf_dir), "vec_id", "gate", "v").select("vec_id", F.col("gate").cast("long").alias("gate"), neat("v").alias("v"))


@query(f"""WITH {GATES}, i AS (SELECT vec_id, gate, gate - row_number() OVER (PARTITION BY vec_id ORDER BY gate) AS island FROM e WHERE v > 0.1)
SELECT vec_id, min(gate) AS start, max(gate) AS "end", count(*) AS length FROM i GROUP BY vec_id, island HAVING count(*) >= 2""")
def threshold_runs(spark, sf_dir):
    return frames.islands(gates(spark, sf_dir), "vec_id", "gate", F.col("v") > 0.1, 2).select("vec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "length")


@query(f"""WITH {GATES} SELECT vec_id, gate, round(sum(v) OVER w, 6) + 0.0 AS total, count(v) OVER w AS n FROM e
WINDOW w AS (PARTITION BY vec_id ORDER BY gate ROWS UNBOUNDED PRECEDING)""")
def prefix_sum(spark, sf_dir):
    return frames.prefix_sum(gates(spark, sf_dir), "vec_id", "gate", "v").select("vec_id", F.col("gate").cast("long").alias("gate"), neat("total").alias("total"), "n")


@query(f"""WITH {GATES}, d AS (SELECT *, sum(v) OVER w AS s, count(v) OVER w AS c FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT vec_id, gate, sum(s) OVER w AS s, sum(c) OVER w AS c FROM d WINDOW w AS (PARTITION BY gate ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT vec_id, gate, round(s / c, 6) + 0.0 AS mean, CAST(c AS BIGINT) AS n FROM b""")
def boxcar_2d(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = blocks.boxed(rows, [], "vec_id", "v", 2, 1, width=4096).select("vec_id", F.posexplode(F.arrays_zip("mean", "n_values")).alias("gate", "x"))
    return found.select("vec_id", F.col("gate").cast("long").alias("gate"), neat("x.mean").alias("mean"), F.col("x.n_values").alias("n"))


@query(f"WITH {GATES} SELECT vec_id, round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS most FROM e WHERE gate >= 8 AND gate < 24 GROUP BY vec_id")
def band_stats(spark, sf_dir):
    return aggregates.band(gates(spark, sf_dir), "vec_id", "gate", "v", 8, 24).select("vec_id", neat("mean").alias("mean"), neat("most").alias("most"))


@query(f"""WITH {GATES}, f AS (SELECT vec_id // 10 AS "row", gate, avg(v) AS v FROM e GROUP BY ALL)
SELECT "row", gate // 8 AS col, round(avg(v), 6) + 0.0 AS mean FROM f GROUP BY ALL""")
def block_mean_2step(spark, sf_dir):
    return aggregates.block_mean(gates(spark, sf_dir), "vec_id", "gate", "v", 10, 8).select("row", "col", neat("mean").alias("mean"))


@query(f"WITH {GATES}, s AS (SELECT vec_id, gate, v > 0.1 AS hit, lag(gate) OVER (PARTITION BY vec_id, v > 0.1 ORDER BY gate) AS seen FROM e), b AS (SELECT vec_id, min(gate) AS stop FROM s WHERE hit AND gate - coalesce(seen, -1) > 7 GROUP BY vec_id) SELECT e.vec_id, max(CASE WHEN hit AND (stop IS NULL OR gate < stop) THEN gate END) AS last FROM s e LEFT JOIN b USING (vec_id) GROUP BY e.vec_id")
def fill_depth(spark, sf_dir):
    return frames.fill_depth(gates(spark, sf_dir), "vec_id", "gate", F.col("v") > 0.1, 6).select("vec_id", F.col("last").cast("long").alias("last"))


@query(f"""WITH {GATES}, o AS (SELECT *, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r FROM e),
q AS (SELECT *, pow(greatest(least((r - 30.0::DOUBLE) / 170.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 2.0::DOUBLE) AS o FROM o)
SELECT vec_id, gate, round(CASE WHEN o >= 0.125::DOUBLE THEN v * r * r / o END, 4) + 0.0 AS corrected FROM q""")
def overlap_correct(spark, sf_dir):
    r = F.col("gate") * F.lit(10.0) + F.lit(5.0)
    rows = gates(spark, sf_dir).withColumn("r", r).withColumn("o", fn.overlap("r"))
    return rows.select("vec_id", F.col("gate").cast("long").alias("gate"), neat(F.when(F.col("o") >= 0.125, F.col("v") * F.col("r") * F.col("r") / F.col("o")), 4).alias("corrected"))


@query(f"""WITH {GATES} SELECT vec_id, gate, round(log10(greatest(v, 0.05::DOUBLE, 1e-30::DOUBLE)), 6) + 0.0 AS log_v,
round(CASE WHEN v < 0.05 THEN 0.5::DOUBLE ELSE 0.05::DOUBLE / (v * 2.302585092994046::DOUBLE) END, 6) + 0.0 AS log_error FROM e""")
def log_field(spark, sf_dir):
    return gates(spark, sf_dir).select("vec_id", F.col("gate").cast("long").alias("gate"), neat(fn.log_value("v", F.lit(0.05))).alias("log_v"), neat(fn.log_error("v", F.lit(0.05))).alias("log_error"))


# -- scalar expressions


@query(f"""WITH {EVENTS} SELECT event_id, CAST(CASE WHEN value IS NULL THEN 0 WHEN value <= 0 THEN 1
ELSE 1 + round_even(greatest(least((log10(value) - 0.0) / 3.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) * 254, 0) END AS INTEGER) AS code FROM ev""")
def quantise_log10(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.quantise("value", 0.0, 3.0).alias("code"))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 256 > 0 THEN round(-7.5::DOUBLE + ((event_id % 256) - 1) / 254.0::DOUBLE * 4.0::DOUBLE, 6) + 0.0 END AS decade FROM ev")
def decode_codes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", neat(fn.decode(F.col("event_id") % 256)).alias("decade"))


@query(f"""WITH {EVENTS}, q AS (SELECT event_id, event_id % 256 AS q FROM ev)
SELECT event_id, concat_ws(',', {", ".join(f"CASE WHEN q & {b} <> 0 THEN '{n}' END" for n, b in sorted(fn.QUALITY.items(), key=lambda x: x[1]))}) AS flags FROM q""")
def decode_flags(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.array_join(fn.flag_names(F.col("event_id") % 256), ",").alias("flags"))


@query(f"WITH {EVENTS} SELECT event_id, event_id % 256 & 167 <> 0 AS wide FROM ev WHERE event_id % 256 & 39 <> 0")
def screened_filter(spark, sf_dir):
    q = F.col("event_id") % 256
    return events(spark, sf_dir).where(fn.screened(q)).select("event_id", fn.screened(q, wide=True).alias("wide"))


@query("""WITH h AS (SELECT o_orderkey, printf('%05X', (o_orderkey * 7919) & 1048575) AS h FROM orders), v AS (SELECT *, ('0x' || h)::BIGINT AS v FROM h)
SELECT o_orderkey, h, CASE WHEN v > 524287 THEN v - 1048576 ELSE v END AS v FROM v""")
def hex_decode_20bit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", fn.hex_encode(F.col("o_orderkey") * 7919).alias("h"))
    return rows.select("o_orderkey", "h", fn.hex_field("h").alias("v"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '')::BIGINT AS number,
len(string_split(regexp_extract(url, '^https?://[^?#]*', 0), '/')) - 3 AS depth FROM pages""")
def message_parse_regex(spark, sf_dir):
    url = F.col("url")
    number = F.nullif(F.regexp_extract(url, "/([0-9]+)", 1), F.lit("")).cast("long")
    depth = F.size(F.split(F.regexp_extract(url, "^https?://[^?#]*", 0), "/")) - 3
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("host"), number.alias("number"), depth.cast("long").alias("depth"))


@query(f"WITH {EVENTS} SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ev")
def json_meta(spark, sf_dir):
    return layers.typed(events(spark, sf_dir), "props").select("event_id", layers.meta_value("$.k", "long", "props").alias("k"))


# -- aggregations


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, median(value) AS m FROM ev GROUP BY event_type)
SELECT event_type, round(median(abs(value - m)) * 1.4826::DOUBLE, 6) + 0.0 AS spread FROM ev JOIN m USING (event_type) GROUP BY event_type""")
def robust_mad(spark, sf_dir):
    return aggregates.robust_std(events(spark, sf_dir), "event_type", "value").select("event_type", neat("spread").alias("spread"))


@query(f"""WITH {EVENTS} SELECT event_type, round(quantile_cont(log10(value), 0.01), 6) + 0.0 AS p01, round(quantile_cont(log10(value), 0.5), 6) + 0.0 AS p50,
round(quantile_cont(log10(value), 0.99), 6) + 0.0 AS p99 FROM ev WHERE value > 0 GROUP BY event_type""")
def percentiles(spark, sf_dir):
    rows = events(spark, sf_dir).where("value > 0").withColumn("decade", F.log10("value"))
    found = aggregates.exact_percentiles(rows, ["event_type"], "decade", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    return found.select("event_type", *[neat(p).alias(p) for p in ("p01", "p50", "p99")])


@query(f"WITH {EVENTS} SELECT user_id, bit_or({BIT_SQL}) AS quality FROM ev GROUP BY user_id")
def quality_bit_or(spark, sf_dir):
    return aggregates.any_bits(events(spark, sf_dir).withColumn("quality", bit()), ["user_id"], "quality")


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY event_type")
def count_by_type_span(spark, sf_dir):
    return aggregates.spans(events(spark, sf_dir), ["event_type"], "t")


@query(f"""WITH {EVENTS}, d AS (SELECT event_type, (lead(t) OVER (PARTITION BY event_type ORDER BY t, event_id) - t) / 1e6::DOUBLE AS d FROM ev)
SELECT event_type, round(quantile_cont(d, 0.5), 6) + 0.0 AS cadence FROM d WHERE d IS NOT NULL GROUP BY event_type""")
def cadence_median(spark, sf_dir):
    steps = temporal.stepped(events(spark, sf_dir), ["event_type"], "t", "step").withColumn("step", F.col("step") / 1e6)
    return aggregates.exact_percentiles(steps.where("step IS NOT NULL"), ["event_type"], "step", {"cadence": 0.5}).select("event_type", neat("cadence").alias("cadence"))


@query("""WITH j AS (SELECT n_chars > 2000 AS flag, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (flag AND truth) AS hits, count(*) FILTER (flag AND NOT truth) AS extra, count(*) FILTER (NOT flag AND truth) AS missed FROM j)
SELECT hits, extra, missed, round(coalesce(hits / nullif(hits + missed, 0)::DOUBLE, 1.0), 6) + 0.0 AS recall, round(coalesce(hits / nullif(hits + extra, 0)::DOUBLE, 1.0), 6) + 0.0 AS precision FROM c""")
def screening_score(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    found = aggregates.screening_score(rows, F.col("n_chars") > 2000, F.col("quality") == 1)
    return found.select("hits", "extra", "missed", neat("recall").alias("recall"), neat("precision").alias("precision"))


@query("""WITH e AS (SELECT l_extendedprice - l_quantity * p_retailprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT count(e) AS n, round(avg(e), 4) + 0.0 AS bias, round(avg(abs(e)), 4) + 0.0 AS mae, round(sqrt(avg(e * e)), 4) + 0.0 AS rmse,
round(quantile_cont(abs(e), 0.95), 4) + 0.0 AS p95, round(avg((abs(e) <= 10000)::INT), 6) + 0.0 AS within FROM e""")
def feature_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = aggregates.error_score(rows, F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice"), 10000.0)
    return found.select("n", *[neat(c, 4).alias(c) for c in ("bias", "mae", "rmse", "p95")], neat("within").alias("within"))


@query(f"""WITH {EVENTS} SELECT user_id, event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS ids FROM ev GROUP BY user_id, event_type""")
def columnar_group(spark, sf_dir):
    found = aggregates.parallel_arrays(events(spark, sf_dir), ["user_id", "event_type"], ["t", "event_id"], {"event_id": 0, "value": 3})
    return found.select("user_id", "event_type", F.size("event_id").cast("long").alias("n"), F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {EVENTS}, b AS (SELECT user_id, t, value, {BIT_SQL} AS q, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) // 9 AS bucket FROM ev)
SELECT user_id, bucket, CAST(floor(avg(t)) AS BIGINT) // 1000 AS t, round(avg(value), 6) + 0.0 AS value, bit_or(q) AS quality FROM b GROUP BY user_id, bucket""")
def downsample_row_bucket(spark, sf_dir):
    rows = frames.row_buckets(events(spark, sf_dir).withColumn("q", bit()), "user_id", ["t", "event_id"], 9)
    found = rows.groupBy("user_id", "bucket").agg(F.floor(F.floor(aggregates.mean_of_whole("t")) / 1000).alias("t"), F.avg("value").alias("value"), F.bit_or("q").alias("quality"))
    return found.select("user_id", F.col("bucket").cast("long").alias("bucket"), "t", neat("value").alias("value"), "quality")


# -- along time


@query(f"""WITH {EVENTS} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS median FROM ev""")
def running_median(spark, sf_dir):
    return blocks.running_median(events(spark, sf_dir), "user_id", ["t", "event_id"], "value", 2).select("event_id", neat("median").alias("median"))


@query(f"""WITH {EVENTS} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN 200 PRECEDING AND 200 FOLLOWING), 6) + 0.0 AS median FROM ev""")
def running_median_wide(spark, sf_dir):
    """401 rows wide: a sorted window slides in haloed blocks."""
    return blocks.running_median(events(spark, sf_dir), "event_type", ["t", "event_id"], "value", 200, size=1024).select("event_id", neat("median").alias("median"))


@query(f"""WITH {EVENTS}, h AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 3 ELSE 11 END AS h FROM ev)
SELECT event_id, round(avg(value) OVER w, 6) + 0.0 AS mean, round(min(value) OVER w, 6) + 0.0 AS least FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN h PRECEDING AND h FOLLOWING)""")
def frames_of_two_widths(spark, sf_dir):
    """Users with frames of 7 and of 23 rows in one call."""
    rows = events(spark, sf_dir).withColumn("half", F.when(F.col("user_id") % 2 == 0, 3).otherwise(11))
    return blocks.ranging(rows, ["user_id"], ["t", "event_id"], "value", "half", size=64).select("event_id", neat("mean").alias("mean"), neat("least").alias("least"))


def _running_mean_sql(value: str) -> str:
    return f"""WITH {EVENTS}, r AS (SELECT event_id, user_id, {value} AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
p AS (SELECT event_id, user_id, unnest([least(greatest(x, 1), c) for x in range(k - least(7, c) // 2, k - least(7, c) // 2 + least(7, c))]) AS k FROM r)
SELECT p.event_id, round(avg(v), 6) + 0.0 AS mean FROM p JOIN r USING (user_id, k) GROUP BY p.event_id"""


@query(_running_mean_sql("value"))
def running_mean_edge_replicate(spark, sf_dir):
    return frames.running_mean(events(spark, sf_dir), "user_id", ["t", "event_id"], "value", 3, size=16).select("event_id", neat("mean").alias("mean"))


@query(_running_mean_sql("CASE WHEN event_id % 5 > 1 AND t // 3600000000 % 3 > 0 THEN value END"))
def running_mean_nulls(spark, sf_dir):
    holes = F.when((F.col("event_id") % 5 > 1) & (F.floor(F.col("t") / HOUR) % 3 > 0), F.col("value"))
    return frames.running_mean(events(spark, sf_dir).withColumn("value", holes), "user_id", ["t", "event_id"], "value", 3).select("event_id", neat("mean").alias("mean"))


@query(f"""WITH {EVENTS} SELECT event_id, round(min(value) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS least FROM ev""")
def running_min_rows(spark, sf_dir):
    return frames.running_min(events(spark, sf_dir), "event_type", ["t", "event_id"], "value", 4, size=1024).select("event_id", neat("least").alias("least"))


@query(f"""WITH {EVENTS} SELECT event_id, round(min(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING), 6) + 0.0 AS least FROM ev""")
def running_min_time_range(spark, sf_dir):
    return frames.running_min_range(events(spark, sf_dir), "user_id", "t", "value", 6 * HOUR).select("event_id", neat("least").alias("least"))


@query(f"""WITH {EVENTS} SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dilated FROM ev""")
def dilate_flag(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("flag", F.col("event_type") == "error")
    return frames.dilate(rows, "user_id", ["t", "event_id"], "flag").select("event_id", "dilated")


@query(f"WITH {EVENTS} SELECT t // {6 * HOUR} AS bucket, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM ev GROUP BY ALL")
def tumbling_buckets(spark, sf_dir):
    found = windows.tumbling(events(spark, sf_dir), [], "t", "6 hours", "0 seconds", F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.floor(F.col("from") / (6 * HOUR)).alias("bucket"), "n", neat("total", 4).alias("total"))


SESSIONS = f"""{EVENTS}, o AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {24 * HOUR} AS o FROM ev),
s AS (SELECT *, CAST(coalesce(sum(o::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS session FROM o)"""


@query(f"WITH {SESSIONS} SELECT event_id, session FROM s")
def sessionise_gap(spark, sf_dir):
    return temporal.sessions(events(spark, sf_dir), "user_id", "t", "event_id", 24 * HOUR).select("event_id", "session")


@query(f"WITH {SESSIONS}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, session) AS support FROM s) SELECT event_id, support FROM c WHERE support >= 3")
def min_support_tracks(spark, sf_dir):
    rows = temporal.sessions(events(spark, sf_dir), "user_id", "t", "event_id", 24 * HOUR)
    return temporal.supported(rows, ["user_id", "session"], 3).select("event_id", "support")


DAILY = f"{EVENTS}, d AS (SELECT user_id, t // {24 * HOUR} AS day, avg(value) AS v FROM ev GROUP BY ALL)"


@query(f"""WITH {DAILY}, n AS (SELECT *, lead(day) OVER w AS d2, lead(v) OVER w AS v2 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
g AS (SELECT user_id, day, v, d2, v2, unnest(range(day + 1, d2)) AS p FROM n WHERE d2 - day > 1 AND d2 - day <= 5)
SELECT user_id, day, round(v, 5) + 0.0 AS v, false AS interpolated FROM d UNION ALL SELECT user_id, p, round(v + (v2 - v) * ((p - day) / (d2 - day)::DOUBLE), 5) + 0.0, true FROM g""")
def gap_fill_lerp(spark, sf_dir):
    daily = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.avg("value").alias("v"))
    return temporal.fill_gaps(daily, "user_id", "day", "v", 5).select("user_id", "day", neat("v", 5).alias("v"), "interpolated")


@query(f"""WITH {EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, t, max(event_id) AS click_id FROM ev WHERE event_type = 'click' GROUP BY ALL)
SELECT p.event_id, c.click_id, p.t - c.t AS age FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t""")
def asof_backward(spark, sf_dir):
    ev = events(spark, sf_dir)
    right = ev.where("event_type = 'click'").withColumn("click_id", F.col("event_id")).withColumn("click_t", F.col("t"))
    found = temporal.asof_backward(ev.where("event_type = 'purchase'").select("event_id", "user_id", "t"), right, "user_id", "t", "event_id", ["click_id", "click_t"])
    return found.select("event_id", F.col("match.click_id").alias("click_id"), (F.col("t") - F.col("match.click_t")).alias("age"))


@query(f"""WITH {EVENTS}, m AS (SELECT c.event_id, p.event_id AS other_id, p.t - c.t AS apart, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(p.t - c.t), p.event_id) AS k
FROM ev c JOIN ev p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND abs(p.t - c.t) <= {24 * HOUR})
SELECT c.event_id, m.other_id, m.apart FROM ev c LEFT JOIN m ON c.event_id = m.event_id AND k = 1 WHERE c.event_type = 'click'""")
def nearest_with_tolerance(spark, sf_dir):
    ev = events(spark, sf_dir)
    right = ev.where("event_type = 'purchase'").select("user_id", F.col("t").alias("other_t"), F.col("event_id").alias("other_id"))
    return temporal.nearest(ev.where("event_type = 'click'"), right, "user_id", "t", "other_t", "event_id", "other_id", 24 * HOUR)


@query(f"""WITH {EVENTS} SELECT a.event_id, count(b.event_id) AS n FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.t - b.t) <= {HOUR} GROUP BY a.event_id""")
def interval_join(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "t")
    other = ev.select("user_id", F.col("t").alias("other_t"), F.col("event_id").alias("other_id"))
    return temporal.within(ev, other, "user_id", "t", "other_t", HOUR).groupBy("event_id").agg(F.count("other_id").alias("n"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM ev) SELECT user_id, event_type, event_id FROM r WHERE k = 1""")
def dedup_top1(spark, sf_dir):
    return temporal.first_of(events(spark, sf_dir), ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("user_id", "event_type", "event_id")


@query(f"WITH {EVENTS} SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, round(max(value), 6) + 0.0 AS value FROM ev GROUP BY user_id")
def best_layer(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("confidence"))
    return layers.surest(rows, ["user_id"], ["event_id"]).select("user_id", "event_id", neat("confidence").alias("value"))


@query(f"WITH {EVENTS} SELECT count(*) AS n, min(t) AS first_t FROM ev WHERE t >= (SELECT max(t) FROM ev) - {72 * HOUR}")
def retention_window(spark, sf_dir):
    return temporal.retained(events(spark, sf_dir), "t", 72 * HOUR).agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query(f"""WITH {EVENTS}, b AS (SELECT min(t) + {48 * HOUR} AS lo, min(t) + {96 * HOUR} AS hi FROM ev)
SELECT event_id, round(value, 6) + 0.0 AS value FROM ev, b WHERE NOT t BETWEEN lo AND hi UNION ALL SELECT event_id, round(value * 2, 6) + 0.0 FROM ev, b WHERE t BETWEEN lo AND hi""")
def range_replace(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("t").alias("t")).first()["t"] or 0
    lo, hi = first + 48 * HOUR, first + 96 * HOUR
    new = ev.where(F.col("t").between(lo, hi)).withColumn("value", F.col("value") * 2)
    return temporal.replace_range(ev, new, "t", lo, hi).select("event_id", neat("value").alias("value"))


@query(f"""WITH {EVENTS} SELECT event_id, t, event_type, round(value, 6) + 0.0 AS value FROM ev WHERE event_type IN ('purchase', 'click') AND value >= 50 AND t >= (SELECT min(t) FROM ev) + {24 * HOUR} AND t <= (SELECT min(t) FROM ev) + {72 * HOUR}""")
def layers_filter(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("t").alias("t")).first()["t"] or 0
    rows = ev.select("event_id", "t", F.col("event_type").alias("type"), F.col("value").alias("confidence"), F.col("event_id").alias("base"), F.lit(False).alias("interpolated"))
    found = layers.selected(rows, F.lit(first + 24 * HOUR), F.lit(first + 72 * HOUR), ["purchase", "click"], 50.0)
    return found.select("event_id", "t", F.col("type").alias("event_type"), neat("confidence").alias("value"))


@query(f"""WITH {EVENTS}, x AS (SELECT *, t // {HOUR} AS h FROM ev), m AS (SELECT *, max(CASE WHEN event_type = 'view' THEN value END) OVER (PARTITION BY h) AS top FROM x)
SELECT event_id, round(CASE WHEN event_type = 'click' AND top IS NOT NULL THEN top ELSE 0 END, 6) + 0.0 AS base, round(CASE WHEN event_type = 'click' AND top IS NOT NULL THEN greatest(value, top) ELSE value END, 6) + 0.0 AS top FROM m""")
def reconcile_stack(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("t") / HOUR).alias("h"), F.col("event_type").alias("type"), F.lit(0.0).alias("base"), F.col("value").alias("top"))
    return layers.stacked(rows, ["h"], "view", "click").select("event_id", neat("base").alias("base"), neat("top").alias("top"))


@query(f"""WITH {EVENTS}, c AS (SELECT *, lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 AS same FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c""")
def interpolation_runs(spark, sf_dir):
    return frames.change_runs(events(spark, sf_dir), "user_id", ["t", "event_id"], "event_type").select("event_id", "run")


# -- chained preprocessing

#: Limits for profiles of 64 gates; label stands for the site and vec_id for the time.
SHALLOW = preprocess.Settings(rain_beta=0.1, rain_depth=60.0, rain_gap=60.0, fog_beta=0.1, fog_above=300.0, fog_span=340.0, fog_snr=0.2, low_from=200.0, low_to=400.0, low_snr=0.1, smooth_half_rows=2, smooth_half_gates=1)
HEIGHTS = f"""{GATES}, g AS (SELECT e.*, label AS site, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r, 0.05::DOUBLE AS s FROM e JOIN embeddings USING (vec_id))"""


def screened_sql(heights: str, sigma: str) -> str:
    """CTEs up to q (vec_id, site, depth, quality), from g (vec_id, site, gate, r, v, s). A missing median counts as 0."""
    return f"""{heights}, h AS (SELECT *, lag(gate) OVER (PARTITION BY vec_id ORDER BY gate) AS seen FROM g WHERE r >= 100 AND v > 0.1::DOUBLE),
stops AS (SELECT vec_id, min(gate) AS stop FROM h WHERE gate - coalesce(seen, 9) > 7 GROUP BY vec_id),
tops AS (SELECT h.vec_id, max(r) - 100.0::DOUBLE AS depth FROM h LEFT JOIN stops USING (vec_id) WHERE stop IS NULL OR gate < stop GROUP BY h.vec_id),
k AS (SELECT vec_id, site, max(v) FILTER (WHERE r BETWEEN 100 AND 300) AS peak, coalesce(median(v / {sigma}) FILTER (WHERE r BETWEEN 300 AND 640), 0) AS above, coalesce(median(v / {sigma}) FILTER (WHERE r BETWEEN 200 AND 400), 0) AS low FROM g GROUP BY ALL),
f AS (SELECT k.*, coalesce(depth, 0) AS depth, coalesce(depth, 0) >= 60 AS rain FROM k LEFT JOIN tops USING (vec_id)),
f2 AS (SELECT *, NOT rain AND coalesce(peak, 0) >= 0.1::DOUBLE AND above < 0.2::DOUBLE AS fog FROM f),
f3 AS (SELECT *, bool_or(rain) OVER w AS wet, bool_or(fog) OVER w AS dim, NOT rain AND NOT fog AND low < 0.1::DOUBLE AS faint FROM f2 WINDOW w AS (PARTITION BY site ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
q AS (SELECT vec_id, site, depth, CAST(CASE WHEN wet THEN 1 WHEN dim THEN 2 ELSE 0 END + CASE WHEN faint THEN 4 ELSE 0 END AS BIGINT) AS quality FROM f3)"""


SCREENED = screened_sql(HEIGHTS, "s")


def _heights(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("site"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("beta"), F.lit(0).alias("quality"))
    return rows.withColumn("r", F.transform("beta", lambda _x, i: i * F.lit(10.0) + F.lit(5.0))).withColumn("sigma", F.transform("beta", lambda _x: F.lit(0.05)))


@query(f"WITH {SCREENED} SELECT vec_id, quality, round(depth, 3) + 0.0 AS depth FROM q")
def screen_profiles(spark, sf_dir):
    return preprocess.screen(_heights(spark, sf_dir), SHALLOW).select(F.col("t").alias("vec_id"), "quality", neat("rain_depth", 3).alias("depth"))


@query(f"""WITH {SCREENED}, u AS (SELECT g.site, g.vec_id, gate, CASE WHEN quality & 39 = 0 THEN v END AS v, quality FROM g JOIN q USING (vec_id)),
d AS (SELECT *, sum(v) OVER w AS s, count(v) OVER w AS c FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT *, sum(s) OVER w AS total, sum(c) OVER w AS n FROM d WINDOW w AS (PARTITION BY site, gate ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT vec_id, max(n) AS most FROM b GROUP BY vec_id)
SELECT vec_id, gate, round(CASE WHEN n > 0 THEN total / n END, 6) + 0.0 AS beta_smooth, round(CASE WHEN n > 0 THEN 0.05::DOUBLE / sqrt(n) END, 6) + 0.0 AS sigma_smooth,
CASE WHEN most < 3.75 THEN quality | 128 ELSE quality END AS quality FROM b JOIN m USING (vec_id)""")
def screened_smooth(spark, sf_dir):
    rows = preprocess.smooth(preprocess.screen(_heights(spark, sf_dir), SHALLOW), SHALLOW)
    rows = rows.select(F.col("t").alias("vec_id"), "quality", F.posexplode(F.arrays_zip("beta_smooth", "sigma_smooth")).alias("gate", "x"))
    return rows.select("vec_id", F.col("gate").cast("long").alias("gate"), neat("x.beta_smooth").alias("beta_smooth"), neat("x.sigma_smooth").alias("sigma_smooth"), "quality")
