"""From raw to screened and smoothed profiles: rows (site, t, beta, r, quality), gates in arrays.

What concerns one profile is an expression on its row. What runs along time works on narrow rows of a site, dealt by
blocks with a halo, and is joined back by (site, t), which is unique; all these joins share one partitioning. Frames count
rows, whatever the time between them. Sites are not null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import aggregates, blocks, facts, frames, temporal
from profilion.session import settle

SITE, TIME = "site", "t"


@dataclass(frozen=True)
class Settings:
    """The defaults, in metres, per metre and steradian, and rows."""

    far_from: float = 6000.0
    noise_half: int = 7
    speckle: float = 0.02
    usable: float = 0.125
    rain_from: float = 100.0
    rain_beta: float = 1e-5
    rain_depth: float = 800.0
    rain_gap: float = 150.0
    fog_to: float = 300.0
    fog_beta: float = 3e-5
    fog_above: float = 600.0
    fog_span: float = 1400.0
    fog_snr: float = 2.0
    low_from: float = 200.0
    low_to: float = 1500.0
    low_snr: float = 1.5
    smooth_time: float = 300.0
    smooth_height: float = 40.0
    overlap_start: float = 30.0
    overlap_full: float = 200.0
    overlap_shape: float = 2.0
    overlap_error: float = 0.5
    #: Half widths of the box in rows and gates; None: as many as smooth_time and smooth_height hold.
    smooth_half_rows: int | None = None
    smooth_half_gates: int | None = None


def spacing(r: Column | str) -> Column:
    """Median distance of neighbouring gates."""
    r = fn.column(r)
    return array_median(F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda k: F.get(r, k) - F.get(r, k - 1)))


def cadence(profiles: DataFrame) -> float | None:
    """Median time between neighbouring profiles of a site, in seconds."""
    steps = temporal.stepped(profiles.select(SITE, TIME), [SITE], TIME, "step").select("step", F.lit(0).alias("one"))
    row = aggregates.exact_percentiles(steps, ["one"], "step", {"m": 0.5}).first()
    return None if row is None else row["m"] / 1e6


def boxes(profiles: DataFrame, s: Settings) -> DataFrame:
    """Profiles with box_rows and box_gates, the half widths of the box that they are smoothed by: those of the settings, or of each site
    as many as smooth_time and smooth_height hold at its cadence and its first grid's spacing. So sites of any cadences and
    grids go through one call."""
    fixed = {c: F.lit(v) for c, v in (("box_rows", s.smooth_half_rows), ("box_gates", s.smooth_half_gates)) if v is not None}
    if len(fixed) == 2:
        return profiles.withColumns(fixed)
    steps = aggregates.exact_percentiles(temporal.stepped(profiles.select(SITE, TIME), [SITE], TIME, "step"), [SITE], "step", {"m": 0.5})
    grids = profiles.groupBy(SITE).agg(F.min_by(spacing("r"), TIME).alias("dz"), F.count("*").alias("wanted"))
    half = lambda span, step: F.when(step > 0, F.floor(F.greatest(F.rint(span / step), F.lit(1.0)) / 2)).otherwise(0).cast("int")
    found = grids.join(steps, F.coalesce(steps[SITE] == grids[SITE], F.lit(False)), "left").drop(steps[SITE])
    found = settle(found.select(SITE, "wanted", half(F.lit(s.smooth_time * 1e6), F.col("m")).alias("box_rows"), half(F.lit(s.smooth_height), F.col("dz")).alias("box_gates")))
    found = facts.joined(profiles, found, [SITE], "wanted", found.agg(F.sum("wanted")).first()[0] or 0)
    return found.withColumns({"box_rows": F.coalesce("box_rows", F.lit(0)), "box_gates": F.coalesce("box_gates", F.lit(0))} | fixed)


def lowest_usable_height(s: Settings = Settings()) -> float:
    """Height of the overlap at which gates are used from."""
    return s.overlap_start + (s.overlap_full - s.overlap_start) * s.usable ** (1.0 / s.overlap_shape)


array_median = fn.array_median


def within(values: str, lo: float, hi: float) -> Column:
    """The values of gates from lo to hi, in order."""
    return F.filter(values, lambda _x, i: F.get("r", i).between(lo, hi))


def median_within(values: str, lo: float, hi: float) -> Column:
    """Their median: 0 if none of the gates has a value, NULL if there is no gate."""
    return F.coalesce(array_median(within(values, lo, hi)), F.when(F.exists("r", lambda h: h.between(lo, hi)), F.lit(0.0)))


def quantile_of(r: str, share: float) -> Column:
    """A quantile of sorted values, with linear interpolation."""
    at = (F.size(r) - 1) * F.lit(share)
    low = F.get(r, F.floor(at).cast("int"))
    return low + (F.coalesce(F.get(r, F.floor(at).cast("int") + 1), low) - low) * (at - F.floor(at))


def zipped(values: str, f) -> Column:
    """f(value, range) of each gate."""
    return F.zip_with(values, "r", f)


def prefix_depth(first: float, least: float, gap: float) -> Column:
    """Height above ``first`` of the last gate over ``least``, scanned upward, until misses span more than ``gap``."""
    most = F.greatest(F.rint(F.lit(gap) / spacing("r")), F.lit(1.0))
    gates = F.filter(F.arrays_zip(F.col("beta").alias("b"), F.col("r").alias("h")), lambda g: g["h"] >= first)
    start = F.struct(F.lit(0).alias("missed"), F.lit(None).cast("double").alias("top"), F.lit(False).alias("over"))

    def step(state, g, most):
        hit = F.coalesce(g["b"] > least, F.lit(False))
        missed = F.when(hit, 0).otherwise(state["missed"] + 1)
        top = F.when(hit & ~state["over"], g["h"]).otherwise(state["top"])
        return F.struct(missed.alias("missed"), top.alias("top"), (state["over"] | (missed > most)).alias("over"))

    return fn.let(most, lambda most: F.coalesce(F.aggregate(gates, start, lambda state, g: step(state, g, most))["top"] - first, F.lit(0.0)))


def screen(profiles: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Sets the bits of rain, fog and low signal in quality; rain and fog reach one row to both sides, and fog
    gives way to rain. Needs beta and sigma."""
    snr = F.zip_with("beta", "sigma", lambda b, e: F.when(e > 0, b / e))
    rows = profiles.withColumn("snr", snr).withColumn("rain_depth", prefix_depth(s.rain_from, s.rain_beta, s.rain_gap))
    rows = rows.withColumn("peak", F.array_max(within("beta", s.rain_from, s.fog_to)))
    rows = rows.withColumn("snr_above", median_within("snr", s.fog_above, s.fog_above + s.fog_span)).withColumn("snr_low", median_within("snr", s.low_from, s.low_to))
    rain = F.col("rain_depth") >= s.rain_depth
    fog = ~rain & F.coalesce((F.col("peak") >= s.fog_beta) & (F.col("snr_above") < s.fog_snr), F.lit(False))
    rows = rows.withColumn("rain", rain).withColumn("fog", fog).withColumn("low", ~rain & ~fog & F.coalesce(F.col("snr_low") < s.low_snr, F.lit(False)))
    near = frames.haloed(frames.numbered(rows.select(SITE, TIME, "rain", "fog"), [SITE], TIME), 1)
    around = Window.partitionBy(SITE, "_block").orderBy("i").rowsBetween(-1, 1)
    near = near.withColumn("wet", F.bool_or("rain").over(around)).withColumn("dim", F.bool_or("fog").over(around) & ~F.col("wet")).where("_home")
    rows = rows.join(settle(near.select(SITE, TIME, "wet", "dim")), [SITE, TIME])
    flags = F.when(F.col("wet"), 1).otherwise(0) + F.when(F.col("dim"), 2).otherwise(0) + F.when(F.col("low"), 4).otherwise(0)
    return rows.withColumn("quality", F.coalesce("quality", F.lit(0)).cast("long").bitwiseOR(flags.cast("long"))).drop("snr", "rain", "fog", "low", "wet", "dim")


def smooth(profiles: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds beta_smooth, the mean of the unscreened values in a box of rows and gates, and its sigma_smooth."""
    rows = boxes(profiles, s).withColumn("_v", F.when(fn.screened("quality"), F.transform("beta", lambda _b: F.lit(None).cast("double"))).otherwise(F.col("beta")))
    rows = blocks.boxed(rows, [SITE], TIME, "_v", "box_rows", "box_gates", "beta_smooth", "_n")
    spread = F.transform(F.arrays_zip(F.col("sigma").alias("e"), F.col("beta_smooth").alias("m"), F.col("_n").alias("n")), lambda x: F.when(x["m"].isNotNull(), x["e"] / F.sqrt(F.greatest(x["n"], F.lit(1)))))
    box = (2 * F.col("box_rows") + 1) * (2 * F.col("box_gates") + 1)
    thin = F.coalesce(F.array_max("_n"), F.lit(0)) < F.greatest(0.25 * box, F.lit(1.0))
    rows = rows.withColumn("sigma_smooth", spread).withColumn("quality", F.when(thin, F.col("quality").bitwiseOR(F.lit(128).cast("long"))).otherwise(F.col("quality")))
    return rows.drop("_v", "_n", "box_rows", "box_gates")


def preprocess(profiles: DataFrame, s: Settings = Settings(), range_corrected: bool = False) -> DataFrame:
    """Range, background and overlap corrected, with noise, screened and smoothed. A column range_corrected, if there is one,
    says so for each profile."""
    known = F.col("range_corrected") if "range_corrected" in profiles.columns else F.lit(range_corrected)
    rows = profiles.withColumn("beta", zipped("beta", lambda b, r: F.when(known, b).otherwise(b * r * r)))
    rows = rows.withColumn("far", F.filter(zipped("beta", lambda b, r: F.when(r >= s.far_from, b / (r * r))), lambda x: x.isNotNull()))
    enough = F.size(F.filter("r", lambda h: h >= s.far_from)) >= 10
    rows = rows.withColumn("offset", F.when(enough, array_median(F.col("far"))))
    offset = frames.running_mean(settle(rows.select(SITE, TIME, "offset")), SITE, [TIME], "offset", s.noise_half).select(SITE, TIME, F.coalesce("mean", F.lit(0.0)).alias("offset"))
    rows = rows.drop("offset").join(settle(offset), [SITE, TIME])
    open_ = lambda r: fn.overlap(r, s.overlap_start, s.overlap_full, s.overlap_shape)
    seen = lambda x, r: F.when(open_(r) >= s.usable, x / F.when(open_(r) > 0, open_(r)))
    rows = rows.withColumn("beta", zipped("beta", lambda b, r: seen(b - F.col("offset") * r * r, r)))
    least = F.when(enough, F.lit(s.far_from)).otherwise(quantile_of("r", 0.9))
    far = fn.let(least, lambda h: F.filter(zipped("beta", lambda b, r: F.when(r >= h, b / (r * r))), lambda x: x.isNotNull()))
    spread = fn.let(far, lambda v: fn.let(array_median(v), lambda m: array_median(F.transform(v, lambda x: F.abs(x - m)))))
    noise = rows.select(SITE, TIME, (F.lit(1.4826) * spread).alias("noise"))
    noise = settle(frames.running_mean(settle(noise), SITE, [TIME], "noise", s.noise_half).select(SITE, TIME, F.col("mean").alias("noise")))
    usual = aggregates.exact_percentiles(noise, [SITE], "noise", {"usual": 0.5})
    noise = noise.join(usual, SITE, "left").select(SITE, TIME, F.coalesce(F.when(F.col("noise") > 0, F.col("noise")), F.when(F.col("usual") > 0, F.col("usual")), F.lit(1e-30)).alias("noise"))
    rows = rows.drop("far").join(noise, [SITE, TIME])
    rows = rows.withColumn("sigma", zipped("beta", lambda b, r: F.hypot(seen(F.col("noise") * r * r, r), F.lit(s.speckle) * F.coalesce(F.abs(b), F.lit(0.0)))))
    return smooth(settle(screen(rows, s)), s)
