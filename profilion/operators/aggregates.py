"""Aggregations: robust spread, bands, blocks, percentiles and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilion.session import settle

#: Values that one task may sort for a key, and bins that a range is cut into.
SORTED, BINS = 100_000, 4096
#: Ranks of large groups that may be broadcast.
BROADCAST = 100_000


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column each, for groups of any size.

    Small groups are sorted. In a large one, a wanted rank is looked for in a histogram of BINS ranges of values, then in
    one of the range that holds it, and so on, until that holds few rows or one value alone; only then are its rows
    sorted. A rank costs a few passes with an aggregate each, and no task holds a group."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    groups = settle(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    on = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))
    small, large = groups.where(F.col("n") <= SORTED), groups.where(F.col("n") > SORTED)
    exact = [F.percentile("v", F.lit(p)).alias(name) for name, p in shares.items()]
    found = rows.join(small, on(rows, small), "left_semi").groupBy(*keys).agg(*exact)
    if large.isEmpty():
        return found
    # ranks from 0, both neighbours of each share; what lies before the range that is looked at
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("share"), F.lit(k).alias("side")) for name, p in shares.items() for k in (0, 1)])
    ranks = large.withColumn("w", F.explode(wanted)).select(*keys, "w.*", "n", "lo", "hi", F.lit(0).cast("long").alias("before"))
    rank = F.least(F.floor(F.col("share") * (F.col("n") - 1)) + F.col("side"), F.col("n") - 1).alias("rank")
    ranks = settle(ranks.select("*", rank).withColumn("many", F.col("n")))
    while not ranks.where((F.col("many") > SORTED) & (F.col("lo") < F.col("hi"))).isEmpty():
        open_ = ranks.where((F.col("many") > SORTED) & (F.col("lo") < F.col("hi")))
        inside = _inside(rows, open_, keys).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)))
        same = [*keys, "name", "side"]
        bins = inside.groupBy(*same, "rank", "share", "n", "before", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*same).orderBy("bin"))
        bins = bins.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        closer = bins.select(*keys, "name", "share", "side", "n", "lo", "hi", (F.col("upto") - F.col("c")).alias("before"), "rank", F.col("c").alias("many"))
        ranks = settle(ranks.where((F.col("many") <= SORTED) | (F.col("lo") >= F.col("hi"))).unionByName(closer))
    few = _inside(rows, ranks.where("lo < hi"), keys)
    place = F.row_number().over(Window.partitionBy(*keys, "name", "side").orderBy("v")) - 1
    got = few.withColumn("place", place).where(F.col("place") == F.col("rank") - F.col("before")).select(*keys, "name", "share", "side", "n", "v")
    got = got.unionByName(ranks.where("lo = hi").select(*keys, "name", "share", "side", "n", F.col("lo").alias("v")))
    low, high = (F.max(F.when(F.col("side") == k, F.col("v"))) for k in (0, 1))
    at = F.max("share") * (F.max("n") - 1)
    one = got.groupBy(*keys, "name").agg((low + (high - low) * (at - F.floor(at))).alias("v"))
    wide = one.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return found.unionByName(wide)


def _inside(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each rank's range. Only groups of more than SORTED values have ranks here, so there are few, and where a count
    says so they are broadcast: a group's values stay where they are."""
    other = ranks.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in ranks.columns if c not in keys])
    other = F.broadcast(other) if ranks.count() <= BROADCAST else other
    same = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(other, same).drop(*[f"_{k}" for k in keys])


def mean_of_whole(c: str) -> Column:
    """The mean of whole numbers from their exact sum, rounded once. (The sum of a few times in microseconds is above 2^53, so that
    ``avg``, which adds doubles, is off by parts of one, and by which depends on the order of rows.)"""
    total, n = F.sum(F.col(c).cast("decimal(38,0)")), F.count(c)
    rest = F.pmod(total, n.cast("decimal(38,0)"))
    return F.when(n > 0, ((total - rest) / n).cast("decimal(38,0)").cast("double") + rest.cast("double") / n)


def robust_std(rows: DataFrame, key: str, value: str) -> DataFrame:
    """1.4826 times the median distance from the median."""
    centre = settle(exact_percentiles(rows, [key], value, {"centre": 0.5}))
    apart = rows.join(centre, rows[key].eqNullSafe(centre[key])).select(rows[key], F.abs(F.col(value) - F.col("centre")).alias("apart"))
    return exact_percentiles(apart, [key], "apart", {"spread": 0.5}).withColumn("spread", F.col("spread") * 1.4826)


def band(rows: DataFrame, key: str, at: str, value: str, lo: float, hi: float) -> DataFrame:
    """Mean and largest value where lo <= at < hi."""
    return rows.where((F.col(at) >= lo) & (F.col(at) < hi)).groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("most"))


def block_mean(rows: DataFrame, time: str, place: str, value: str, time_factor: int, place_factor: int) -> DataFrame:
    """Means of blocks in two steps, over time and then over places, so that gaps weigh as they do there."""
    first = rows.groupBy(F.floor(F.col(time) / time_factor).alias("row"), F.col(place)).agg(F.avg(value).alias("v"))
    return first.groupBy("row", F.floor(F.col(place) / place_factor).alias("col")).agg(F.avg("v").alias("mean"))


def error_score(rows: DataFrame, error, tolerance: float) -> DataFrame:
    """Bias, mean absolute error, RMSE, 95th percentile and the share within the tolerance."""
    e = rows.select(error.alias("e"), F.lit(0).alias("one"))
    sums = e.groupBy("one").agg(F.count("e").alias("n"), F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg((F.abs("e") <= tolerance).cast("double")).alias("within"))
    far = exact_percentiles(e.withColumn("e", F.abs("e")), ["one"], "e", {"p95": 0.95})
    return sums.join(far, "one", "left").drop("one")


def screening_score(rows: DataFrame, flag, truth) -> DataFrame:
    """Recall and precision; 1 where there is nothing to find or nothing was flagged."""
    c = lambda x: F.count_if(x)
    counted = rows.agg(c(flag & truth).alias("hits"), c(flag & ~truth).alias("extra"), c(~flag & truth).alias("missed"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(1.0))
    return counted.withColumn("recall", ratio("hits", "missed")).withColumn("precision", ratio("hits", "extra"))


def parallel_arrays(rows: DataFrame, keys: list[str], order: list[str], fields: dict[str, int]) -> DataFrame:
    """The rows of each group as arrays in order, fields rounded to so many digits (0: as they are).

    A group is one served window or station, so its arrays are bounded by what a client asks for."""
    one = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *fields])))).alias("all"))

    def field(name: str, digits: int):
        return F.transform("all", lambda x: F.round(x[name], digits) if digits else x[name]).alias(name)

    return one.select(*keys, *[field(name, digits) for name, digits in fields.items()])


def any_bits(rows: DataFrame, keys: list[str], bits: str) -> DataFrame:
    """(keys, bits): all bits that any row of a group has."""
    return rows.groupBy(*keys).agg(F.bit_or(bits).alias(bits))


def spans(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, n, first, last) of each group: how many rows, and the least and largest ``at``, as first_<at> and last_<at>."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias(f"first_{at}"), F.max(at).alias(f"last_{at}"))
