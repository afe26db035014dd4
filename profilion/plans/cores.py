"""Queries that reach the cores of detection, tracking, the store and the logs. Names as in ``plans.catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from profilion.operators import detect, layers, preprocess, track
from profilion.plans import domain
from profilion.plans import window as windows
from profilion.plans.catalog import EVENTS, GATES, HOUR, events, neat, query, table
from profilion.session import shared_folder
from profilion.sources import messages
from profilion.sources.store import Store, Table

MINUTE = 60_000_000


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


# -- detection


@query(domain.edges_sql())
def edges_in_sql(spark, sf_dir):
    """What ``edge_candidates`` gives, by a table function in SQL."""
    s = detect.Settings(scales=domain.EDGES.scales, lowest=90.0, highest=550.0, least_step=0.03, significance=0.3)
    rows = domain.flat(spark, sf_dir).withColumn("beta_smooth", F.transform("beta", lambda v, i: F.abs(v) + 0.06 + i * 0.0001))
    detect.register_edges(spark, s)
    detect.edge_inputs(rows, s).createOrReplaceTempView("profilion_profiles")
    return spark.sql("""SELECT t AS vec_id, scale, sign, height, round(strength, 5) + 0.0D AS strength, round(amplitude, 6) + 0.0D AS amplitude
        FROM profile_edges(TABLE(SELECT site, t, r, ceiling, _log, _log_error, _linear, _linear_error, _bias FROM profilion_profiles))""")


_BOX = "ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING"


@query(f"""WITH {GATES}, u AS (SELECT vec_id, label AS site, gate, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE v END AS v FROM e JOIN embeddings USING (vec_id)),
d AS (SELECT *, sum(v) OVER w AS t, count(v) OVER w AS c FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY gate {_BOX.format(2)})),
b AS (SELECT *, sum(t) OVER w AS total, sum(c) OVER w AS n FROM d WINDOW w AS (PARTITION BY site, gate ORDER BY vec_id {_BOX.format(3)})),
m AS (SELECT vec_id, max(n) AS most FROM b GROUP BY vec_id)
SELECT vec_id, gate, round(CASE WHEN n > 0 THEN total / n END, 5) + 0.0 AS mean, round(CASE WHEN n > 0 THEN 0.05::DOUBLE / sqrt(n) END, 6) + 0.0 AS error, most < 8.75 AS thin FROM b JOIN m USING (vec_id)""")
def smooth_flagged(spark, sf_dir):
    """The box mean of unscreened profiles on arrays, by site."""
    rows = domain.flat(spark, sf_dir).drop("beta_smooth", "sigma_smooth").withColumn("quality", F.when(F.col("t") % 11 == 0, 1).otherwise(0).cast("long"))
    found = preprocess.smooth(rows, preprocess.Settings(smooth_half_rows=3, smooth_half_gates=2))
    found = found.select(F.col("t").alias("vec_id"), (F.col("quality").bitwiseAND(128) != 0).alias("thin"), F.posexplode(F.arrays_zip("beta_smooth", "sigma_smooth")).alias("gate", "x"))
    return found.select("vec_id", F.col("gate").cast("long").alias("gate"), neat("x.beta_smooth", 5).alias("mean"), neat("x.sigma_smooth").alias("error"), "thin")


@query(f"""WITH {GATES}, s AS (SELECT vec_id, label % 2 AS site, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) - 1 AS k FROM embeddings),
u AS (SELECT e.*, site, k, CASE WHEN site = 0 THEN 5 ELSE 1 END AS hr, CASE WHEN site = 0 THEN 2 ELSE 1 END AS hg FROM e JOIN s USING (vec_id)),
d AS (SELECT *, sum(v) OVER w AS t, count(v) OVER w AS c FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN hg PRECEDING AND hg FOLLOWING)),
b AS (SELECT *, sum(t) OVER w AS total, sum(c) OVER w AS n FROM d WINDOW w AS (PARTITION BY site, gate ORDER BY k ROWS BETWEEN hr PRECEDING AND hr FOLLOWING))
SELECT vec_id, gate, round(total / n, 5) + 0.0 AS mean FROM b""")
def smooth_sites(spark, sf_dir):
    """Two sites in one call: profiles each 30 s and gates each 10 m at one, 120 s and 15 m at the other, each smoothed over 300 s and 40 m."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("site"), "vec_id", F.col("embedding").cast("array<double>").alias("beta"), F.lit(0).cast("long").alias("quality"))
    placed = preprocess.frames.numbered(rows, ["site"], "vec_id").withColumn("t", F.col("i") * F.when(F.col("site") == 0, 30_000_000).otherwise(120_000_000)).drop("i", "n")
    apart = F.when(F.col("site") == 0, 10.0).otherwise(15.0)
    placed = placed.withColumn("r", F.transform("beta", lambda _b, i: (i + 0.5) * apart)).withColumn("sigma", F.transform("beta", lambda _b: F.lit(0.05)))
    found = preprocess.smooth(placed).select("vec_id", F.posexplode("beta_smooth").alias("gate", "mean"))
    return found.select("vec_id", F.col("gate").cast("long").alias("gate"), neat("mean", 5).alias("mean"))


@query(f"""WITH {GATES}, g AS (SELECT *, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r, count(*) OVER (PARTITION BY vec_id) AS gates FROM e),
f AS (SELECT *, CASE WHEN gate >= 2 AND gate + 2 <= gates THEN (sum(v) OVER (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - sum(v) OVER (PARTITION BY vec_id ORDER BY gate ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) / 4 END AS w FROM g),
h AS (SELECT *, gate - row_number() OVER (PARTITION BY vec_id ORDER BY gate) AS island FROM g WHERE v > 0.1::DOUBLE AND r >= 90),
c AS (SELECT vec_id, min(r) AS low, max(v) AS peak, arg_min(gate, (-v, gate)) AS at FROM h GROUP BY vec_id, island HAVING count(*) >= 2),
b AS (SELECT c.*, (SELECT median(g.v) FROM g WHERE g.vec_id = c.vec_id AND g.r >= low - 300 AND g.r < low) AS below,
  (SELECT arg_min(f.r, (f.w, f.gate)) FROM f WHERE f.vec_id = c.vec_id AND f.w IS NOT NULL AND f.r >= low - 40 AND f.r < low + 40) AS steep,
  (SELECT min(g.r) FROM g WHERE g.vec_id = c.vec_id AND g.gate >= c.at AND NOT g.v > 0.1::DOUBLE) AS top FROM c),
o AS (SELECT b.*, (SELECT median(g.v / 0.05::DOUBLE) FROM g WHERE g.vec_id = b.vec_id AND g.r >= top + 50 AND g.r < top + 150) AS above FROM b WHERE peak >= 0.5::DOUBLE * greatest(coalesce(below, 0), 0.15::DOUBLE))
SELECT vec_id, coalesce(steep, low) AS base, CASE WHEN above >= 0 THEN top END AS top, coalesce(above < 0, true) AS opaque, round(peak, 6) + 0.0 AS peak FROM o""")
def cloud_bases(spark, sf_dir):
    """Bases at the steepest rise near where a cloud begins, tops where light comes through, opaque clouds without one."""
    s = detect.Settings(cloud=0.1, cloud_sharp=0.5, scales=(40.0, 80.0), opaque_depth=100.0, opaque_snr=0.0)
    found = detect.clouds(domain.flat(spark, sf_dir), s).select(F.col("t").alias("vec_id"), F.explode("clouds").alias("x"))
    return found.select("vec_id", "x.base", "x.top", "x.opaque", neat("x.peak_beta").alias("peak"))


# -- tracks


@query(f"""WITH {EVENTS}, d AS (SELECT CAST(user_id % 10 AS BIGINT) AS site, t // {MINUTE} * {MINUTE} AS t, min(event_id) AS id FROM ev GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) - 1 AS i FROM d), k AS (SELECT *, CASE WHEN id % 4 = 0 THEN id * 1.0::DOUBLE END AS base FROM p),
c AS (SELECT *, last_value(CASE WHEN base IS NOT NULL THEN {{'i': i, 't': t, 'base': base}} END IGNORE NULLS) OVER (PARTITION BY site ORDER BY i) AS b,
  first_value(CASE WHEN base IS NOT NULL THEN {{'i': i, 't': t, 'base': base}} END IGNORE NULLS) OVER (PARTITION BY site ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM k)
SELECT site, t, round(CASE WHEN base IS NOT NULL THEN base ELSE b.base + (a.base - b.base) * (i - b.i) / (a.i - b.i)::DOUBLE END, 5) + 0.0 AS base, base IS NULL AS interpolated,
  CASE WHEN base IS NULL THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM c WHERE base IS NOT NULL OR (a.t - b.t <= {10 * HOUR})""")
def gaps_filled(spark, sf_dir):
    """A track of each site in a fourth of its profiles; gaps of up to ten hours are filled in a straight line, half as sure."""
    times = events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("site"), (F.floor(F.col("t") / MINUTE) * MINUTE).alias("t")).agg(F.min("event_id").alias("id"))
    rows = times.where("id % 4 = 0").select("site", "t", F.lit("haze").alias("type"), F.col("id").cast("double").alias("base"), F.lit(None).cast("double").alias("top"), F.lit(0.8).alias("confidence"), F.lit("{}").alias("meta"), F.col("site").cast("string").alias("track"))
    found = track.filled(rows, times.select("site", "t"), track.Settings(gap=36_000.0))
    return found.select("site", "t", neat("base", 5).alias("base"), "interpolated", "confidence")


# -- layers of the store


@query(f"""WITH {domain.LAYERS}, m AS (SELECT *, CASE type WHEN 'mixing_layer' THEN confidence * 2 WHEN 'haze' THEN confidence END AS contrast FROM l)
SELECT site, t, type, base, round(contrast, 6) + 0.0 AS contrast, CASE WHEN type = 'mixing_layer' THEN 1::BIGINT END AS sign FROM m WHERE contrast >= 0.5""")
def meta_variant(spark, sf_dir):
    """Metas whose shapes differ by type, stored as VARIANT, and a filter on one field across types: as a number, a text, or not there."""
    rows = domain.layers_of(spark, sf_dir)
    sure = F.col("confidence")
    meta = F.when(F.col("type") == "mixing_layer", F.to_json(F.struct((sure * 2).alias("contrast"), F.struct(F.lit(1).alias("sign")).alias("edge")))).when(F.col("type") == "haze", F.to_json(F.struct(sure.alias("contrast"), F.array(F.lit(1), F.lit(2)).alias("clouds")))).otherwise('{"contrast": "none"}')
    kept = Table(spark, _folder(spark), 6 * HOUR)
    kept.write(layers.typed(rows.withColumn("meta", meta)))
    contrast = layers.meta_value("$.contrast", "double")
    return kept.rows().where(contrast >= 0.5).select("site", "t", "type", "base", neat(contrast).alias("contrast"), layers.meta_value("$.edge.sign", "long").alias("sign"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 2 = 1) AS odd FROM embeddings)
SELECT name, units, caveat, CASE name WHEN 'quality' THEN odd ELSE n END AS n FROM n, (VALUES ('t', 'microseconds since 1970-01-01 UTC', false), ('r', 'm', true), ('beta', 'counts', false), ('quality', '1', false)) a(name, units, caveat)""")
def store_attributes(spark, sf_dir):
    """Units and caveats of columns, read back after a range was replaced: the source's own, where it tells them, or the store's."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * MINUTE).alias("t"), F.col("embedding").cast("array<double>").alias("beta"), F.when(F.col("vec_id") % 2 == 1, 1).cast("long").alias("quality"))
    rows = rows.withColumn("r", F.transform("beta", lambda _b, i: (i + 0.5) * 10.0)).withMetadata("beta", {"units": "counts"})
    kept = Table(spark, _folder(spark), 6 * HOUR, ["t"])
    kept.write(rows)
    kept.write(rows.where(F.col("t").between(HOUR, 4 * HOUR)).select("t", "r", F.col("beta").alias("beta", metadata={}), "quality"))
    told = kept.attributes()
    stored = kept.rows().agg(*[F.count(c).alias(c) for c in told])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(m["units"]).alias("units"), F.lit("comment" in m).alias("caveat"), F.col(c).alias("n")) for c, m in told.items()])
    return stored.select(F.explode(each).alias("x")).select("x.*")


@query(f"""WITH {GATES}, p AS (SELECT vec_id, CAST(label % 2 AS VARCHAR) AS site, vec_id * {MINUTE} AS t FROM embeddings), h AS (SELECT site, max(t) AS hi FROM p GROUP BY site),
w AS (SELECT p.*, row_number() OVER (PARTITION BY p.site ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY p.site) AS n FROM p JOIN h USING (site) WHERE t >= hi - {6 * HOUR}),
f AS (SELECT w.site, i // greatest(1, CAST(ceil(n / 16.0) AS BIGINT)) AS "row", gate, avg(v * CASE WHEN site = '0' THEN 1 ELSE 100 END) AS v FROM w JOIN e USING (vec_id) GROUP BY ALL),
g AS (SELECT max(len(embedding)) AS g FROM embeddings), c AS (SELECT site, "row", gate // greatest(1, CAST(ceil(g / 16.0) AS BIGINT)) AS col, avg(v) AS v FROM f, g GROUP BY ALL)
SELECT site, "row", col, round(v, 4) + 0.0 AS v FROM c""")
def window_of_sites(spark, sf_dir):
    """The last six hours of two sites whose values differ by a factor of 100: each in a window of its own."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("string").alias("site"), (F.col("vec_id") * MINUTE).alias("t"), (F.col("label") % 2 == 0).alias("plain"), F.col("embedding").cast("array<double>").alias("beta"), F.lit(0).cast("long").alias("quality"))
    rows = rows.withColumn("beta", F.transform("beta", lambda b: b * F.when(F.col("plain"), 1.0).otherwise(100.0))).drop("plain").withColumn("r", F.transform("beta", lambda _b, i: (i + 0.5) * 10.0))
    store = Store(spark, _folder(spark), retention_hours=1_000_000)
    store.write(rows)
    found = windows.windows_of_sites(store, windows.Request(hours=6, max_rows=16, max_gates=16))
    return found.select("site", "row", F.posexplode("beta").alias("col", "v")).select("site", "row", F.col("col").cast("long").alias("col"), neat("v", 4).alias("v"))


# -- logs


@query(f"""WITH {GATES}, v AS (SELECT vec_id, gate, 1767225600000000 + vec_id * 30000000 AS t, round_even(v / 1e-5::DOUBLE, 0) * 1e-5::DOUBLE AS v FROM e)
SELECT t, gate, gate * 10.0::DOUBLE + 5.0::DOUBLE AS r, round(v, 6) + 0.0 AS v, true AS crc_ok FROM v""")
def messages_round_trip(spark, sf_dir):
    """Vectors written as a whole log of messages, stamped, framed and with their checksums, and read back as one."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 30_000_000 + 1_767_225_600_000_000).alias("t"), F.col("embedding").cast("array<double>").alias("beta"))
    folder = _folder(spark)
    messages.write(rows.withColumn("r", F.transform("beta", lambda _b, i: i * 10.0 + 5.0)), folder, unit=1e-5)
    found = messages.read(spark, folder, unit=1e-5)
    return found.select("t", "crc_ok", F.posexplode(F.arrays_zip("r", "beta")).alias("gate", "x")).select("t", F.col("gate").cast("long").alias("gate"), F.col("x.r").alias("r"), neat("x.beta").alias("v"), "crc_ok")
