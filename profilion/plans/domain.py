"""Queries of the store, detection, tracking, scoring and windows, with their SQL. Names as in ``plans.catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import aggregates, detect, frames, layers, preprocess, score, temporal, track
from profilion.plans import window as windows
from profilion.plans.catalog import BIT_SQL, EVENTS, GATES, HOUR, ORACLES, bit, events, gates, neat, query, screened_sql, table
from profilion.session import shared_folder
from profilion.sources import messages
from profilion.sources.store import Store, Table

SIX = 6 * HOUR


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


# -- the store

BLOCKS = f"""{EVENTS}, a AS (SELECT CAST(user_id % 2 AS BIGINT) AS site, t // 60000000 * 60000000 AS t, min(event_id) AS value FROM ev GROUP BY ALL),
b AS (SELECT site, t, value + 1000000 AS value FROM a WHERE t // {SIX} - (SELECT min(t) FROM a) // {SIX} IN (2, 6)),
s AS (SELECT site, min(t) AS lo, max(t) AS hi FROM b GROUP BY site)"""


@query(f"WITH {BLOCKS} SELECT a.* FROM a LEFT JOIN s USING (site) WHERE lo IS NULL OR NOT t BETWEEN lo AND hi UNION ALL SELECT * FROM b")
def store_replace(spark, sf_dir):
    """Two sites; a second write that spans buckets which it leaves empty; of equal times the least value stays."""
    rows = events(spark, sf_dir).select((F.col("user_id") % 2).alias("site"), (F.floor(F.col("t") / 60_000_000) * 60_000_000).alias("t"), F.col("event_id").alias("value"))
    kept = Table(spark, _folder(spark), SIX, ["site", "t"], ["site"])
    kept.write(rows)
    first = rows.agg(F.min("t")).first()[0] or 0
    again = F.floor(F.col("t") / SIX) - first // SIX
    kept.write(kept.rows().drop("bucket").where(again.isin(2, 6)).withColumn("value", F.col("value") + 1_000_000))
    return kept.rows().select(F.col("site").cast("long").alias("site"), "t", "value")


@query(f"""WITH {EVENTS} SELECT user_id AS site, t, event_type AS type, event_id AS base, round(value, 6) + 0.0 AS confidence FROM ev
WHERE t BETWEEN (SELECT max(t) FROM ev) - {48 * HOUR} AND (SELECT max(t) FROM ev) AND value >= 20 AND event_type IN ('click', 'view') AND event_id % 3 <> 0""")
def store_layers(spark, sf_dir):
    """Layers written with their profiles, read for the last hours, of some types, sure enough, without interpolated ones."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("site"), "t", F.col("event_type").alias("type"), F.col("event_id").alias("base"), F.col("value").alias("confidence"), (F.col("event_id") % 3 == 0).alias("interpolated"))
    store = Store(spark, _folder(spark), retention_hours=1_000_000)
    store.write(rows.select("site", "t").distinct(), rows, origin="events")
    return store.layers(hours=48, types=["click", "view"], least=20.0, interpolated=False).select("site", "t", "type", "base", neat("confidence").alias("confidence"))


@query(f"WITH {EVENTS}, l AS (SELECT max(t) AS m FROM ev) SELECT t // {SIX} * {SIX} AS bucket, min(t) AS first_t, max(t) AS last_t, count(DISTINCT t) AS n FROM ev, l WHERE t >= m - {72 * HOUR} GROUP BY ALL")
def store_catalogue(spark, sf_dir):
    """What a store keeps after a write, by bucket."""
    store = Store(spark, _folder(spark))
    store.write(events(spark, sf_dir).select("t", "event_id"))
    return store.catalogue().select(F.col("bucket").cast("long").alias("bucket"), "first_t", "last_t", "n")


# -- preprocessing

CHAINED = preprocess.Settings(far_from=400.0, noise_half=2, rain_beta=0.1, rain_depth=60.0, rain_gap=60.0, fog_beta=0.1, fog_above=300.0, fog_span=340.0, fog_snr=0.2, low_from=200.0, low_to=400.0, low_snr=0.1, smooth_half_rows=2, smooth_half_gates=1)


def _smoothed_sql(name: str, source: str, value: str) -> str:
    return f"""{name}_r AS (SELECT vec_id, site, {value} AS v, row_number() OVER (PARTITION BY site ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY site) AS c FROM {source}),
{name}_p AS (SELECT vec_id, site, unnest([least(greatest(x, 1), c) for x in range(k - least(5, c) // 2, k - least(5, c) // 2 + least(5, c))]) AS k FROM {name}_r),
{name} AS (SELECT p.vec_id, avg(v) AS v FROM {name}_p p JOIN {name}_r r USING (site, k) GROUP BY p.vec_id)"""


CHAIN = f"""{GATES}, g0 AS (SELECT e.*, label AS site, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r FROM e JOIN embeddings USING (vec_id)),
o1 AS (SELECT vec_id, site, median(v / (r * r)) FILTER (WHERE r >= 400) AS m FROM g0 GROUP BY ALL), {_smoothed_sql("o2", "o1", "m")},
g1 AS (SELECT g0.vec_id, site, gate, r, g0.v - o2.v * r * r AS v, pow(greatest(least((r - 30.0::DOUBLE) / 170.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 2.0::DOUBLE) AS o FROM g0 JOIN o2 USING (vec_id)),
g2 AS (SELECT vec_id, site, gate, r, CASE WHEN o >= 0.125::DOUBLE THEN v / o END AS v, o FROM g1),
n1 AS (SELECT vec_id, site, median(v / (r * r)) AS m FROM g2 WHERE r >= 400 GROUP BY ALL),
n2 AS (SELECT g2.vec_id, g2.site, 1.4826::DOUBLE * median(abs(v / (r * r) - m)) AS m FROM g2 JOIN n1 USING (vec_id) WHERE r >= 400 GROUP BY ALL), {_smoothed_sql("n3", "n2", "m")},
g AS (SELECT g2.vec_id, g2.site, gate, r, g2.v, CASE WHEN o >= 0.125::DOUBLE THEN sqrt(pow(n3.v * r * r / o, 2) + pow(0.02::DOUBLE * abs(g2.v), 2)) END AS s FROM g2 JOIN n3 USING (vec_id))"""


@query(f"""WITH {screened_sql(CHAIN, "s")}, u AS (SELECT g.site, g.vec_id, gate, g.v AS beta, s, CASE WHEN quality & 39 = 0 THEN v END AS v, quality FROM g JOIN q USING (vec_id)),
d AS (SELECT *, sum(v) OVER w AS t, count(v) OVER w AS c FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT *, sum(t) OVER w AS total, sum(c) OVER w AS n FROM d WINDOW w AS (PARTITION BY site, gate ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT vec_id, max(n) AS most FROM b GROUP BY vec_id)
SELECT vec_id, gate, round(beta, 4) + 0.0 AS beta, round(s, 4) + 0.0 AS sigma, round(CASE WHEN n > 0 THEN total / n END, 4) + 0.0 AS beta_smooth,
CASE WHEN most < 3.75 THEN quality | 128 ELSE quality END AS quality FROM b JOIN m USING (vec_id)""")
def preprocess_chain(spark, sf_dir):
    return chained(spark, sf_dir, True)


@query(ORACLES["preprocess_chain"])
def preprocess_uncorrected(spark, sf_dir):
    """The same signals before they are multiplied by the square of their range: what comes out is the same."""
    return chained(spark, sf_dir, False)


def chained(spark, sf_dir, corrected: bool):
    """Vectors as signals, corrected for range or not, through all of preprocessing."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("site"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("beta"), F.lit(0).alias("quality"))
    rows = rows.withColumn("r", F.transform("beta", lambda _x, i: i * F.lit(10.0) + F.lit(5.0)))
    if not corrected:
        rows = rows.withColumn("beta", F.zip_with("beta", "r", lambda b, r: b / (r * r)))
    found = preprocess.preprocess(rows, CHAINED, range_corrected=corrected)
    found = found.select(F.col("t").alias("vec_id"), "quality", F.posexplode(F.arrays_zip("beta", "sigma", "beta_smooth")).alias("gate", "x"))
    return found.select("vec_id", F.col("gate").cast("long").alias("gate"), neat("x.beta", 4).alias("beta"), neat("x.sigma", 4).alias("sigma"), neat("x.beta_smooth", 4).alias("beta_smooth"), "quality")


@query("SELECT vec_id, len(embedding) AS gates, 10.0::DOUBLE AS spacing, 90.1 AS lowest_usable FROM embeddings")
def derived_scalars(spark, sf_dir):
    r = F.transform("embedding", lambda _x, i: i * F.lit(10.0) + F.lit(5.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("gates"), preprocess.spacing(r).alias("spacing"), F.lit(round(preprocess.lowest_usable_height(), 1)).alias("lowest_usable"))


@query(f"""WITH {GATES}, s AS (SELECT vec_id, gate, sum(coalesce(v, 0) * 10.0::DOUBLE) OVER (PARTITION BY vec_id ORDER BY gate) AS depth, sum(v) OVER (PARTITION BY vec_id) AS total FROM e)
SELECT vec_id, gate, round(depth, 5) + 0.0 AS depth, round(total, 5) + 0.0 AS total FROM s""")
def cumulative_depth(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.posexplode(fn.cumulative_depth("v", 10.0)).alias("gate", "depth"), fn.array_sum("v").alias("total"))
    return rows.select("vec_id", F.col("gate").cast("long").alias("gate"), neat("depth", 5).alias("depth"), neat("total", 5).alias("total"))


@query(f"""WITH {GATES} SELECT vec_id, gate, round(CASE WHEN gate * 10.0 + 5.0 < coalesce(CASE WHEN vec_id % 3 > 0 THEN 100.0 + vec_id % 7 * 50.0 END, 1e9) - 50.0 THEN v END, 6) + 0.0 AS v FROM e""")
def clear_of_cloud(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 7 * 50.0 + 100.0).alias("ceiling"))
    rows = rows.withColumn("r", F.transform("v", lambda _x, i: i * F.lit(10.0) + F.lit(5.0)))
    return rows.select("vec_id", F.posexplode(fn.clear_of_cloud("v", "r", "ceiling")).alias("gate", "v")).select("vec_id", F.col("gate").cast("long").alias("gate"), neat("v").alias("v"))


# -- detection

EDGES = detect.Settings(scales=(40.0, 80.0), lowest=90.0, highest=550.0, least_step=0.03)


def edges_sql() -> str:
    w = lambda lo, hi: f"(PARTITION BY vec_id ORDER BY gate ROWS BETWEEN {lo} AND {hi})"

    def step(v: str, n: int) -> str:
        low, high = w(f"{n} PRECEDING", "1 PRECEDING"), w("CURRENT ROW", f"{n - 1} FOLLOWING")
        return f"CASE WHEN count({v}) OVER {low} = {n} AND count({v}) OVER {high} = {n} THEN (sum({v}) OVER {low} / {n}.0::DOUBLE - sum({v}) OVER {high} / {n}.0::DOUBLE) / 2.0::DOUBLE END"

    each = " UNION ALL ".join(
        f"SELECT vec_id, gate, r, {n * 20}.0::DOUBLE AS scale, {step('lv', n)} AS w, CASE WHEN count(le) OVER {w(f'{n} PRECEDING', f'{n - 1} FOLLOWING')} = {2 * n} THEN sqrt(pow(sqrt(sum(le * le) OVER {w(f'{n} PRECEDING', f'{n - 1} FOLLOWING')}) / {2 * n}.0::DOUBLE, 2) + pow({step('bias', n)}, 2)) END AS s FROM l" for n in (2, 4)
    )
    return f"""WITH {GATES}, h AS (SELECT vec_id, gate, abs(v) + 0.06::DOUBLE + gate * 0.0001::DOUBLE AS v, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r FROM e),
l AS (SELECT *, log10(greatest(v, 0.05::DOUBLE)) AS lv, CASE WHEN v < 0.05 THEN 0.5::DOUBLE ELSE 0.05::DOUBLE / (v * ln(10.0::DOUBLE)) END AS le,
  0.5::DOUBLE * (1 - pow(greatest(least((r - 30.0::DOUBLE) / 170.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 2.0::DOUBLE)) / ln(10.0::DOUBLE) AS bias FROM h),
t AS ({each}), m AS (SELECT *, max(CASE WHEN r BETWEEN 90 AND 550 AND s > 0 THEN abs(w) END) OVER (PARTITION BY vec_id, scale) AS most, lag(w) OVER k AS b, lead(w) OVER k AS a FROM t WINDOW k AS (PARTITION BY vec_id, scale ORDER BY gate)),
x AS (SELECT *, 1 AS sign FROM m WHERE w > b AND w >= a AND w / s > 0.3 UNION ALL SELECT *, -1 FROM m WHERE -w > -b AND -w >= -a AND -w / s > 0.3)
SELECT vec_id, scale, CAST(sign AS INTEGER) AS sign, r AS height, round(sign * w / s, 5) + 0.0 AS strength, round(abs(w), 6) + 0.0 AS amplitude FROM x WHERE r BETWEEN 90 AND 550 AND abs(w) >= 0.1 * most AND abs(w) >= 0.03"""


def flat(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("site"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("beta"), F.lit(0).cast("long").alias("quality"))
    rows = rows.withColumn("r", F.transform("beta", lambda _x, i: i * F.lit(10.0) + F.lit(5.0))).withColumn("sigma", F.transform("beta", lambda _x: F.lit(0.05)))
    return rows.withColumn("beta_smooth", F.col("beta")).withColumn("sigma_smooth", F.col("sigma")).withColumn("ceiling", F.lit(None).cast("double"))


@query(edges_sql())
def edge_candidates(spark, sf_dir):
    s = detect.Settings(scales=EDGES.scales, lowest=90.0, highest=550.0, least_step=0.03, significance=0.3)
    rows = flat(spark, sf_dir).withColumn("beta_smooth", F.transform("beta", lambda v, i: F.abs(v) + 0.06 + i * 0.0001))  # no ties
    found = detect.candidates(rows, s).select(F.col("t").alias("vec_id"), F.explode("candidates").alias("x"))
    return found.select("vec_id", "x.scale", "x.sign", "x.height", neat("x.strength", 5).alias("strength"), neat("x.amplitude").alias("amplitude"))


@query(f"""WITH {GATES}, g AS (SELECT *, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r FROM e), h AS (SELECT *, gate - row_number() OVER (PARTITION BY vec_id ORDER BY gate) AS island FROM g WHERE v > 0.1::DOUBLE AND r >= 90),
c AS (SELECT vec_id, min(gate) AS first, min(r) AS low, max(v) AS peak, arg_min(r, (-v, gate)) AS peak_r FROM h GROUP BY vec_id, island HAVING count(*) >= 2),
b AS (SELECT c.vec_id, c.first, c.low, c.peak, c.peak_r, median(g.v) AS below FROM c LEFT JOIN g ON g.vec_id = c.vec_id AND g.r >= low - 300 AND g.r < low GROUP BY ALL)
SELECT vec_id, low AS crossing, round(peak, 6) + 0.0 AS peak_beta, peak_r AS peak_height, round(greatest(least(0.5::DOUBLE + 0.5::DOUBLE * log10(peak / 0.1::DOUBLE), 1.0::DOUBLE), 0.5::DOUBLE), 6) + 0.0 AS confidence FROM b
WHERE peak >= 0.5::DOUBLE * greatest(coalesce(below, 0), 0.15::DOUBLE)""")
def cloud_runs(spark, sf_dir):
    s = detect.Settings(cloud=0.1, cloud_sharp=0.5)
    rows = detect.clouds(flat(spark, sf_dir).withColumn("kept", F.col("beta")), s).select(F.col("t").alias("vec_id"), "beta", "r", F.explode("clouds").alias("x"))
    # the gate where the run of the peak begins
    at = F.array_position("r", F.col("x.peak_height")).cast("int")
    low = F.filter(F.sequence(F.lit(1), at), lambda k: ((F.get("beta", k - 1) > s.cloud) & (F.get("r", k - 1) >= s.lowest)) & ~((k > 1) & F.coalesce((F.get("beta", k - 2) > s.cloud) & (F.get("r", k - 2) >= s.lowest), F.lit(False))))
    return rows.select("vec_id", F.get("r", F.try_element_at(low, F.lit(-1)) - 1).alias("crossing"), neat("x.peak_beta").alias("peak_beta"), "x.peak_height", neat("x.confidence").alias("confidence"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE / 1000 AS i, l_discount::DOUBLE - 0.05 AS o, l_tax::DOUBLE AS n, l_quantity::DOUBLE AS q FROM lineitem),
c AS (SELECT *, i / greatest(o, n, 1e-30::DOUBLE) AS c FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN c < 1e9 THEN round(c, 6) + 0.0 END AS contrast, round(greatest(least((0.5::DOUBLE * q / (q + 3) + 0.3::DOUBLE * (1 + l_linenumber % 5) / 5 + 0.2::DOUBLE * greatest(least(ln(greatest(c, 1)) / ln(3.0::DOUBLE), 1), 0)) * CASE WHEN q * 10 < 200 THEN 0.6::DOUBLE ELSE 1 END, 1), 0), 6) + 0.0 AS confidence FROM c""")
def contrast_confidence(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", detect.contrast(d("l_extendedprice") / 1000, d("l_discount") - 0.05, d("l_tax")).alias("c"), d("l_quantity").alias("q"))
    edge = F.struct(F.col("q").alias("strength"), F.array_repeat(F.lit(1.0), F.col("l_linenumber").cast("int") % 5 + 1).alias("scales"), (F.col("q") * 10).alias("height"))
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("c") < 1e9, neat("c")).alias("contrast"), neat(detect.confidence(edge, F.col("c"))).alias("confidence"))


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, min(CASE WHEN event_type = 'view' AND value > 5 THEN value END) AS low FROM ev GROUP BY user_id)
SELECT event_id, coalesce(low < value - 20, false) AS based FROM ev JOIN a USING (user_id) WHERE event_type = 'purchase'""")
def base_below(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("height", F.col("value"))
    tops, bases = rows.where("event_type = 'purchase'").select("user_id", "event_id", "height"), rows.where("event_type = 'view'").select("user_id", "height")
    parts = [layers.with_base_below(tops, bases, ["user_id"], 5.0, 20.0, there).select("event_id", F.lit(there).alias("based")) for there in (True, False)]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {GATES}, n AS (SELECT q.vec_id, q.gate, arg_min(f.gate, (-f.v, f.gate)) AS peak FROM e q JOIN e f ON q.vec_id = f.vec_id AND f.gate >= q.gate - 3 AND f.gate < q.gate + 3 WHERE q.gate % 8 = 0 GROUP BY ALL)
SELECT vec_id, gate AS height, peak FROM n""")
def edge_to_extremum(spark, sf_dir):
    rows = gates(spark, sf_dir).withColumn("gate", F.col("gate").cast("long"))
    edges = rows.where("gate % 8 = 0").select("vec_id", F.col("gate").alias("height"))
    return layers.nearest_peak(edges, rows.select("vec_id", F.col("gate").alias("at"), "v"), ["vec_id"], 3)


# -- tracks and layers

SINGLE = f"""{EVENTS}, d AS (SELECT user_id, t, max(value) AS v FROM ev GROUP BY ALL), o AS (SELECT *, t - lag(t) OVER w > {24 * HOUR} AS o FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, coalesce(sum(o::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS k FROM o), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, k) AS n FROM s)"""


@query(f"""WITH {SINGLE} SELECT user_id, t, round(list_median([coalesce(lag(v) OVER w, v), v, coalesce(lead(v) OVER w, v)]), 6) + 0.0 AS base, CAST(min(t) OVER (PARTITION BY user_id, k) AS BIGINT) AS track_from FROM c WHERE n >= 3
WINDOW w AS (PARTITION BY user_id, k ORDER BY t)""")
def tracks_single(spark, sf_dir):
    """One detection at a time and no limit to jumps: a track is a session, its heights running medians."""
    rows = events(spark, sf_dir).groupBy("user_id", "t").agg(F.max("value").alias("base"))
    rows = rows.select(F.col("user_id").alias("site"), "t", F.lit("haze").alias("type"), "base", F.lit(None).cast("double").alias("top"), F.lit(1.0).alias("confidence"), F.lit("{}").alias("meta"))
    found = track.smoothed(track.assigned(rows, track.Settings(jump=1e12, gap=24 * 3600.0)), track.Settings(least=3, smooth_half=1))
    return found.select(F.col("site").alias("user_id"), "t", neat("base").alias("base"), F.split("track", ":")[2].cast("long").alias("track_from"))


def layers_of(spark, sf_dir):
    kinds = F.when(F.col("event_type") == "view", "mixing_layer").when(F.col("event_type") == "click", "residual_layer").otherwise("haze")
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("site"), F.floor(F.col("t") / HOUR).alias("t"), kinds.alias("type"), F.col("event_id").cast("double").alias("base"), F.col("value").alias("top"), (F.col("event_id") % 100 / 100.0).alias("confidence"), F.concat(F.lit("x"), F.col("event_id") % 50).alias("track"), (F.col("event_id") % 4 == 0).alias("interpolated"), F.lit("{}").alias("meta"))


LAYERS = f"""{EVENTS}, l AS (SELECT CAST(user_id AS VARCHAR) AS site, t // {HOUR} AS t, CASE event_type WHEN 'view' THEN 'mixing_layer' WHEN 'click' THEN 'residual_layer' ELSE 'haze' END AS type,
CAST(event_id AS DOUBLE) AS base, value AS top, event_id % 100 / 100.0::DOUBLE AS confidence, 'x' || CAST(event_id % 50 AS VARCHAR) AS track, event_id % 4 = 0 AS interpolated FROM ev)"""


@query(f"""WITH {LAYERS} SELECT site, t, type, base FROM (SELECT *, row_number() OVER (PARTITION BY site, t, type ORDER BY interpolated, confidence DESC, base, track) AS k FROM l) WHERE k = 1 OR type = 'haze'""")
def layers_deduplicated(spark, sf_dir):
    return track.deduplicated(layers_of(spark, sf_dir)).select("site", "t", "type", "base")


@query(f"""WITH {LAYERS}, m AS (SELECT *, CASE WHEN type = 'residual_layer' THEN max(CASE WHEN type = 'mixing_layer' THEN top END) OVER (PARTITION BY site, t) END AS u FROM l)
SELECT site, t, type, track, round(coalesce(u, base), 6) + 0.0 AS base, round(CASE WHEN u IS NOT NULL THEN greatest(top, u) ELSE top END, 6) + 0.0 AS top FROM m""")
def layers_stacked(spark, sf_dir):
    return layers.stacked(layers_of(spark, sf_dir), ["site", "t"]).select("site", "t", "type", "track", neat("base").alias("base"), neat("top").alias("top"))


@query(f"""WITH {LAYERS} SELECT site, arg_min(base, (-confidence, base)) AS surest, arg_min(base, (base, track)) AS lowest FROM l GROUP BY site""")
def surest_and_lowest(spark, sf_dir):
    rows = layers_of(spark, sf_dir)
    return layers.surest(rows, ["site"], ["base"]).select("site", F.col("base").alias("surest")).join(layers.lowest(rows, ["site"], ["track"]).select("site", F.col("base").alias("lowest")), "site")


@query(f"WITH {LAYERS} SELECT site, t, type, base, round(top, 6) + 0.0 AS top, track, interpolated FROM l WHERE t BETWEEN (SELECT min(t) + 24 FROM l) AND (SELECT min(t) + 72 FROM l) AND confidence >= 0.5 AND type IN ('haze', 'mixing_layer') AND NOT interpolated")
def layers_selected(spark, sf_dir):
    rows = layers_of(spark, sf_dir)
    first = rows.agg(F.min("t")).first()[0] or 0
    return layers.selected(rows, F.lit(first + 24), F.lit(first + 72), ["haze", "mixing_layer"], 0.5, False).select("site", "t", "type", "base", neat("top").alias("top"), "track", "interpolated")


@query(f"WITH {LAYERS} SELECT site, t, type, base, round(top, 6) + 0.0 AS top, round(confidence, 6) + 0.0 AS confidence, track, interpolated FROM l")
def layers_json_round_trip(spark, sf_dir):
    back = layers.from_json(layers.to_json(layers_of(spark, sf_dir)))
    return back.select("site", "t", "type", "base", neat("top").alias("top"), neat("confidence").alias("confidence"), "track", "interpolated")


@query(f"WITH {LAYERS} SELECT site FROM l GROUP BY site HAVING count(DISTINCT type) = 3")
def sites_with_all_types(spark, sf_dir):
    return layers.holds_types(layers_of(spark, sf_dir), ["site"], ["mixing_layer", "residual_layer", "haze"])


@query(f"WITH {LAYERS} SELECT type, count(*) AS n, count(base) AS bases, count(top) AS tops, count(*) FILTER (interpolated) AS interpolated FROM l GROUP BY type")
def legend_counts(spark, sf_dir):
    return windows.legend(layers_of(spark, sf_dir))


@query(f"""WITH {LAYERS} SELECT type, CASE WHEN track = 'x7' THEN CAST(t AS VARCHAR) || ':' || CAST(base AS VARCHAR) || ':' || type ELSE track END AS track, count(*) AS n, min(t) AS first_t, round(sum(base), 3) + 0.0 AS total FROM l GROUP BY ALL""")
def points_by_track(spark, sf_dir):
    rows = layers_of(spark, sf_dir).withColumn("track", F.when(F.col("track") != "x7", F.col("track")))
    return windows.by_track(rows).select("type", "track", F.size("points").cast("long").alias("n"), F.get("points", F.lit(0))["t"].alias("first_t"), neat(F.aggregate("points", F.lit(0.0), lambda s, p: s + p["base"]), 3).alias("total"))


# -- scores


TRUTH = f"""{LAYERS}, w AS (SELECT DISTINCT site, t, t % 100 * 10.0::DOUBLE AS wanted, t % 3 > 0 AS visible, t % 11 = 0 AS screened FROM l),
f AS (SELECT site, t, arg_min(top, (-confidence, base)) AS found FROM l WHERE type = 'mixing_layer' GROUP BY ALL),
r AS (SELECT w.*, found, visible AS seen, CASE WHEN visible THEN found - wanted END AS e FROM w LEFT JOIN f USING (site, t))"""


@query(f"""WITH {TRUTH} SELECT 'mixing_top' AS feature, count(*) FILTER (seen) AS observable, count(e) AS matched, round(avg(e), 4) + 0.0 AS bias, round(avg(abs(e)), 4) + 0.0 AS mae, round(sqrt(avg(e * e)), 4) + 0.0 AS rmse,
round(quantile_cont(abs(e), 0.95), 4) + 0.0 AS p95, round(avg((abs(e) <= 150)::INT), 6) + 0.0 AS within, round(count(e) / count(*) FILTER (seen)::DOUBLE, 6) + 0.0 AS detection_rate FROM r""")
def layer_scores(spark, sf_dir):
    rows = layers_of(spark, sf_dir)
    truth = rows.select("site", "t").distinct().withColumn("screened", F.col("t") % 11 == 0).withColumn("mixing_top", F.col("t") % 100 * 10.0).withColumn("mixing_visible", F.col("t") % 3 > 0)
    for c in ("residual_top", "haze_base", "haze_top", "cloud_base"):
        truth = truth.withColumn(c, F.lit(None).cast("double"))
    for c in ("residual", "haze", "cloud"):
        truth = truth.withColumn(f"{c}_visible", F.lit(False))
    found = score.feature_scores(rows, truth, ["site", "t"]).where("feature = 'mixing_top'")
    return found.select("feature", "observable", "matched", *[neat(c, 4).alias(c) for c in ("bias", "mae", "rmse", "p95")], neat("within").alias("within"), neat("detection_rate").alias("detection_rate"))


@query(f"""WITH {LAYERS}, w AS (SELECT DISTINCT site, t, t % 5 = 0 AS fog, t % 7 = 0 AS rain, t % 4 AS quality FROM l), x AS (SELECT 'fog' AS screen, fog AS wanted, quality & 2 <> 0 AS flagged FROM w UNION ALL SELECT 'rain', rain, quality & 1 <> 0 FROM w)
SELECT screen, count(*) FILTER (wanted) AS true_n, count(*) FILTER (flagged) AS flagged_n, count(*) FILTER (wanted AND flagged) AS hits, round(coalesce(count(*) FILTER (wanted AND flagged) / nullif(count(*) FILTER (wanted), 0)::DOUBLE, 1), 6) + 0.0 AS recall,
round(coalesce(count(*) FILTER (wanted AND flagged) / nullif(count(*) FILTER (flagged), 0)::DOUBLE, 1), 6) + 0.0 AS precision FROM x GROUP BY screen""")
def screen_scores(spark, sf_dir):
    rows = layers_of(spark, sf_dir).select("site", "t").distinct().withColumn("fog", F.col("t") % 5 == 0).withColumn("rain", F.col("t") % 7 == 0).withColumn("quality", F.col("t") % 4)
    return score.screen_scores(rows, rows, ["site", "t"]).select("screen", "true_n", "flagged_n", "hits", neat("recall").alias("recall"), neat("precision").alias("precision"))


# -- windows


@query(f"""WITH {GATES}, i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), f AS (SELECT i // 7 AS "row", gate, avg(v) AS v FROM e JOIN i USING (vec_id) GROUP BY ALL),
c AS (SELECT "row", gate // 5 AS col, avg(v) AS v FROM f GROUP BY ALL)
SELECT "row", col, CAST(CASE WHEN v IS NULL THEN 0 WHEN v <= 0 THEN 1 ELSE 1 + round_even(greatest(least((log10(v) + 3.0::DOUBLE) / 3.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) * 254, 0) END AS INTEGER) AS code FROM c""")
def window_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("beta"), F.lit(0).cast("long").alias("quality"))
    rows = rows.withColumn("r", F.transform("beta", lambda _x, i: i * F.lit(10.0) + F.lit(5.0)))
    cells = windows.drawn(windows.downsampled(rows, 7, 5), -3.0, 0.0)
    return cells.select("row", F.posexplode("codes").alias("col", "code")).select("row", F.col("col").cast("long").alias("col"), "code")


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) // greatest(1, CAST(ceil(n / 16.0) AS BIGINT)) AS "row" FROM embeddings, n)
SELECT "row", round(avg(vec_id * 30.0::DOUBLE), 3) + 0.0 AS seconds, CAST(bit_or(CASE WHEN label % 2 = 0 THEN 4 ELSE 16 END) AS BIGINT) AS quality, max(gates) AS gates
FROM i, (SELECT CAST(ceil(g / ceil(g / 16.0)) AS BIGINT) AS gates FROM (SELECT max(len(embedding)) AS g FROM embeddings)) GROUP BY "row" """)
def window_payload(spark, sf_dir):
    """A window of all that a store holds, at most 16 by 16 cells."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit("a").alias("site"), (F.col("vec_id") * 30_000_000).alias("t"), F.col("embedding").cast("array<double>").alias("beta"), F.when(F.col("label") % 2 == 0, 4).otherwise(16).cast("long").alias("quality"))
    rows = rows.withColumn("r", F.transform("beta", lambda _x, i: i * F.lit(10.0) + F.lit(5.0)))
    store = Store(spark, _folder(spark), bucket_hours=2000, retention_hours=1_000_000)
    store.write(rows)
    _, cells = windows.assembled(store, windows.Request(hours=None, max_rows=16, max_gates=16))
    return cells.select("row", neat(F.col("t") / 1e6, 3).alias("seconds"), "quality", F.size("codes").cast("long").alias("gates"))


@query(f"WITH {EVENTS}, c AS (SELECT event_id, event_id % 256 AS c FROM ev) SELECT event_id, CAST(CASE WHEN c > 0 THEN 1 + round_even(greatest(least((-7.5::DOUBLE + (c - 1) / 254.0::DOUBLE * 4.0::DOUBLE + 6.5::DOUBLE) / 2.0::DOUBLE, 1), 0) * 254, 0) ELSE 0 END AS INTEGER) AS colour FROM c")
def requantised(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.requantise(F.col("event_id") % 256, fn.VMIN, fn.VMAX, -6.5, -4.5).alias("colour"))


@query(f"""WITH {EVENTS}, b AS (SELECT user_id, t, value, {BIT_SQL} AS q, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) // 9 AS bucket FROM ev)
SELECT user_id, bucket, count(*) AS n, round(avg(value), 6) + 0.0 AS value, bit_or(q) AS quality FROM b GROUP BY user_id, bucket""")
def numbered_buckets(spark, sf_dir):
    """Row buckets by counted places instead of one window for each user."""
    rows = frames.numbered(events(spark, sf_dir).withColumn("q", bit()), ["user_id"], "t", ["event_id"]).withColumn("bucket", F.floor(F.col("i") / 9))
    return rows.groupBy("user_id", "bucket").agg(F.count("*").alias("n"), neat(F.avg("value")).alias("value"), F.bit_or("q").alias("quality"))


@query(f"""WITH {EVENTS}, s AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS step FROM ev) SELECT event_type, round(median(step) / 1e6::DOUBLE, 6) + 0.0 AS cadence, count(step) AS n FROM s GROUP BY event_type""")
def cadence_by_blocks(spark, sf_dir):
    steps = temporal.stepped(events(spark, sf_dir).select("event_type", "t"), ["event_type"], "t", "step").where("step IS NOT NULL")
    found = aggregates.exact_percentiles(steps, ["event_type"], "step", {"m": 0.5}).withColumn("cadence", neat(F.col("m") / 1e6))
    return found.join(steps.groupBy("event_type").agg(F.count("step").alias("n")), "event_type").select("event_type", "cadence", "n")



@query(f"""WITH {GATES}, c AS (SELECT vec_id, gate, CAST(round_even(v * 100000, 0) AS BIGINT) AS c FROM e), s AS (SELECT vec_id, count(*) AS gates, sum(c) AS total, max(abs(c)) AS most FROM c GROUP BY vec_id)
SELECT vec_id, gates, round(total * 1e-3::DOUBLE, 6) + 0.0 AS total, CAST(CASE WHEN vec_id % 4 = 0 THEN 16 ELSE 0 END | CASE WHEN vec_id % 3 = 2 THEN 2 ELSE 0 END | CASE WHEN most >= 524287 THEN 8 ELSE 0 END AS BIGINT) AS quality,
CASE WHEN vec_id % 3 = 1 THEN vec_id % 1000 * 10.0::DOUBLE END AS base, CASE WHEN vec_id % 3 = 2 THEN 90.0::DOUBLE END AS visibility, true AS crc_ok FROM s""")
def message_parse(spark, sf_dir):
    """Vectors written as messages, line by line, and read back."""
    v = F.col("vec_id")
    counts = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.rint(x * 100_000).cast("long"))
    digits = F.array_join(F.transform(counts, fn.hex_encode), "")
    kind = v % 3
    status = F.concat(kind.cast("string"), F.when(v % 4 == 0, "W ").otherwise("0 "), F.when(kind == 1, F.lpad((v % 1000 * 10).cast("string"), 5, "0")).when(kind == 2, "00090").otherwise(""), F.lit(" 00000000"))
    status = F.when(kind == 2, F.concat(F.lit("4"), F.substring(status, 2, 100))).otherwise(status)
    head = F.array(F.lit("CL010112"), status, F.format_string("00100 10 %04d 099 +25 099 0000 L0112HN15 030 000", F.size("embedding")), digits)
    body = F.concat(F.array_join(head, "\r\n"), F.lit("\r\n" + messages.CLOSES))
    closing = F.concat(F.lit(messages.CLOSES), F.lower(F.lpad(F.hex(fn.crc16(body)), 4, "0")))
    rows = table(spark, sf_dir, "embeddings").select(v.cast("string").alias("path"), F.lit(1).alias("message"), F.lit("2026-01-01 00:00:00").alias("stamp"), F.lit(None).cast("timestamp").alias("modified"), F.concat(head, F.array(closing)).alias("lines"))
    found = messages.parse(rows, unit=1e-3)
    return found.select(F.col("path").cast("long").alias("vec_id"), F.size("beta").cast("long").alias("gates"), neat(fn.array_sum("beta")).alias("total"), "quality", F.get("cloud_base_reported", F.lit(0)).alias("base"), F.col("vertical_visibility").alias("visibility"), "crc_ok")
