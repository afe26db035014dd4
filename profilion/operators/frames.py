"""Neighbourhood operators on long tables (key, place, value): frames count rows, not time, but for running_min_range.

Three ways of treating an edge are kept apart: a window that must be whole (Haar), one that is cut short and
averages what it has (``blocks``), and one that repeats the edge value (running mean)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilion.operators import scans


def unroll(profiles: DataFrame, key: str, values: str, place: str = "gate", value: str = "v") -> DataFrame:
    """One row for each element of an array column."""
    return profiles.select(key, F.posexplode(values).alias(place, value)).withColumn(value, F.col(value).cast("double"))


def _over(key: str, order: str, lo: int, hi: int):
    return Window.partitionBy(key).orderBy(order).rowsBetween(lo, hi)


def haar(rows: DataFrame, key: str, order: str, value: str, n: int, out: str = "w") -> DataFrame:
    """Half the difference of the means of n rows before and n from here on; only where all 2n have values."""
    low, high = _over(key, order, -n, -1), _over(key, order, 0, n - 1)
    whole = (F.count(value).over(low) == n) & (F.count(value).over(high) == n)
    w = (F.sum(value).over(low) / float(n) - F.sum(value).over(high) / float(n)) / 2.0
    return rows.withColumn(out, F.when(whole, w))


def haar_noise(rows: DataFrame, key: str, order: str, sigma: str, n: int, out: str = "noise") -> DataFrame:
    both = _over(key, order, -n, n - 1)
    whole = F.count(sigma).over(both) == 2 * n
    return rows.withColumn(out, F.when(whole, F.sqrt(F.sum(F.col(sigma) * F.col(sigma)).over(both)) / (2.0 * n)))


def multiscale(rows: DataFrame, key: str, order: str, value: str, scales: tuple[int, ...]) -> DataFrame:
    """haar at several half widths, one row for each; the table is sorted once for all of them."""
    for n in scales:
        rows = haar(rows, key, order, value, n, f"w{n}")
    stacked = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"w{n}").alias("w")) for n in scales])
    return rows.select(key, order, F.explode(stacked).alias("s")).select(key, order, F.col("s.n").alias("n"), F.col("s.w").alias("w"))


def local_extrema(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows above the one before and not below the one after; all three must have values."""
    w = Window.partitionBy(key).orderBy(order)
    near = rows.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))
    return near.where((F.col(value) > F.col("before")) & (F.col(value) >= F.col("after"))).drop("before", "after")


def islands(rows: DataFrame, key: str, order: str, flag, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive places where flag holds: (key, start, end, length)."""
    w = Window.partitionBy(key).orderBy(order)
    hit = rows.where(flag).withColumn("island", F.col(order) - F.row_number().over(w))
    return hit.groupBy(key, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def prefix_sum(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = _over(key, order, Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(value).over(w)).withColumn("n", F.count(value).over(w))


#: Rows of a block, and microseconds of the buckets that rows are first counted by.
BLOCK, WIDTH = 8192, 6 * 3_600_000_000


def numbered(rows: DataFrame, keys: list[str], at: str, ties: list[str] = [], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """Adds i, each row's place along its keys from 0, and n, how many rows they have. Rows are counted by buckets of ``at``,
    so no task holds more than a bucket of a key. Rows without ``at`` go."""
    rows = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    counts = rows.where(F.col("_bucket").isNotNull()).groupBy(*keys, "_bucket").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_many")
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("_many").over(Window.partitionBy(*keys)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(at, *ties))
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.withColumn("_rank", rank).join(counts, same).withColumn("i", F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_b", "_before", "_rank", *[f"_{k}" for k in keys])


def haloed(rows: DataFrame, half: int, size: int = BLOCK) -> DataFrame:
    """Numbered rows by blocks (column _block) of ``size``; those within half of a neighbouring block go there as well (_home is
    false), so that a frame of half rows never leaves a block."""
    home, at, most = F.floor(F.col("i") / size), F.col("i") % size, max(size, half)
    size_fits = most == size
    near = F.array(F.when(at < half, home - 1), home, F.when(at >= size - half, home + 1)) if size_fits else F.array(F.lit(0).cast("long"))
    rows = rows.withColumn("_block", F.explode(F.filter(near, lambda b: b.isNotNull() & (b >= 0))))
    return rows.withColumn("_home", F.col("_block") == home if size_fits else F.lit(True))


def running_mean(rows: DataFrame, key: str, order: list[str], value: str, half: int, size: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Mean of 2*half+1 rows, or of as many as the key has; beyond an edge its value is repeated. Missing values, at the
    edges too, are left out of both sum and count; without any the mean is NULL."""
    wide = 2 * half + 1
    rows = numbered(rows, [key], order[0], order[1:], width)
    near = haloed(rows.where(F.col("n") >= wide), half, size)
    w = Window.partitionBy(key, "_block").orderBy("i")
    frame, block = w.rowsBetween(-half, half), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, count = F.coalesce(F.sum(value).over(frame), F.lit(0.0)), F.count(value).over(frame)
    # a row this near to an edge has the key's first or last row in its block
    for beyond, edge in ((F.lit(half) - F.col("i"), F.first(value).over(block)), (F.col("i") + half + 1 - F.col("n"), F.last(value).over(block))):
        times = F.when(edge.isNotNull(), F.greatest(beyond, F.lit(0))).otherwise(0)
        total, count = total + times * F.coalesce(edge, F.lit(0.0)), count + times
    large = near.withColumn("mean", total).withColumn("_count", count).where("_home").withColumn("mean", F.when(F.col("_count") > 0, F.col("mean") / F.col("_count"))).drop("_block", "_home", "_count")
    # keys of fewer rows than the frame has
    few = rows.where(F.col("n") < wide)
    values = F.collect_list(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.col("i") - F.floor(F.col("n") / 2)
    seen = F.filter(F.transform(F.sequence(first, first + F.col("n") - 1), lambda k: F.get("_values", F.greatest(F.least(k, F.col("n") - 1), F.lit(0)).cast("int"))["v"]), lambda v: v.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(seen), F.lit(0))
    return large.unionByName(few.withColumn("_values", values).withColumn("mean", mean).drop("_values")).drop("i", "n")


def running_min(rows: DataFrame, key: str, order: list[str], value: str, half: int, size: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Least value of the rows within half of each."""
    near = haloed(numbered(rows, [key], order[0], order[1:], width), half, size)
    least = F.min(value).over(Window.partitionBy(key, "_block").orderBy("i").rowsBetween(-half, half))
    return near.withColumn("least", least).where("_home").drop("_block", "_home", "i", "n")


def running_min_range(rows: DataFrame, key: str, at: str, value: str, reach: int) -> DataFrame:
    """Least value within reach of ``at`` (a frame over values of at, such as microseconds)."""
    return rows.withColumn("least", F.min(value).over(Window.partitionBy(key).orderBy(at).rangeBetween(-reach, reach)))


def half_width(scale: float, spacing: float) -> int:
    """Gates in each half of a window of ``scale`` metres."""
    return max(round(scale / (2.0 * spacing)), 1)


def padded_median(rows: DataFrame, keys: list[str], order: list[str], value: str, half: int, out: str) -> DataFrame:
    """Median of the rows within half of each; beyond an edge its value is repeated, and missing values are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.struct(F.col(value).alias("v"))
    near = [F.coalesce(F.lag(held, k).over(w), F.first(held).over(all_rows)) for k in range(half, 0, -1)] + [held] + [F.coalesce(F.lead(held, k).over(w), F.last(held).over(all_rows)) for k in range(1, half + 1)]
    rows = rows.withColumn("_near", F.array(*near))
    sorted_ = F.array_sort(F.filter(F.transform("_near", lambda x: x["v"]), lambda v: v.isNotNull()))
    n = F.size(sorted_)
    return rows.withColumn(out, F.when(n > 0, (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2.0)).drop("_near")


def dilate(rows: DataFrame, key: str, order: list[str], flag: str, by: int = 1) -> DataFrame:
    return rows.withColumn("dilated", F.bool_or(flag).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-by, by)))


def row_buckets(rows: DataFrame, key: str, order: list[str], factor: int, size: int = scans.BLOCK) -> DataFrame:
    """Numbers of ``factor`` consecutive rows each, from the key's first row."""
    placed = scans.placed(rows, [key], [F.col(c) for c in order], size=size)
    return scans.unplaced(scans.scanned(placed, [key], _n=scans.Scan("sum", F.lit(1))).withColumn("bucket", F.floor((F.col("_n") - 1) / factor)).drop("_n"))


def change_runs(rows: DataFrame, key: str, order: list[str], state: str, size: int = scans.BLOCK) -> DataFrame:
    """Numbers the runs of equal state along each key, from 1: changes are found and counted in two levels."""
    placed = scans.placed(rows, [key], [F.col(c) for c in order], size=size)
    changed = scans.scanned(placed, [key], _p=scans.previous(F.col(state)))
    same = F.col("_p").isNotNull() & F.col("_p.v").eqNullSafe(F.col(state))
    return scans.unplaced(scans.scanned(changed.withColumn("_changed", F.when(same, 0).otherwise(1)).drop("_p"), [key], run=scans.Scan("sum", F.col("_changed"))).drop("_changed"))


def fill_depth(rows: DataFrame, key: str, order: str, hit, tolerance: int) -> DataFrame:
    """Last hit from the start of each key on, before the first run of more than ``tolerance`` misses."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("seen", F.last(F.when(hit, F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("broken", F.max((F.col(order) - F.coalesce("seen", F.lit(-1)) > tolerance + 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key).agg(F.max(F.when(hit & (F.col("broken") == 0), F.col(order))).alias("last"))
