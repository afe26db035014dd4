"""Operators along time: as-of and interval joins, sessions, gap filling, retention and replacement of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilion.operators import frames, scans


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, payload: list[str], size: int = scans.BLOCK) -> DataFrame:
    """Each left row with the last right row of its key at or before it: a union, and the last match carried along the key in two
    levels, so a key of any length is many tasks; no range join."""
    both = left.withColumn("side", F.lit(1)).withColumn("match", F.lit(None).cast(right.select(F.struct(*payload).alias("m")).schema["m"].dataType))
    other = right.select(key, at, F.col(tie), F.lit(0).alias("side"), F.struct(*payload).alias("match"))
    placed = scans.placed(both.unionByName(other, allowMissingColumns=True), [key], [F.col(at), F.col("side"), F.col(tie)], size=size)
    rows = scans.scanned(placed.withColumnRenamed("match", "_match"), [key], match=scans.Scan("last", F.col("_match")))
    return scans.unplaced(rows.where("side = 1").drop("side", "_match"))


def bucketed(rows: DataFrame, at: str, width: int, spread: bool) -> DataFrame:
    """Adds the bucket of ``at``; with spread, a row for the buckets on both sides as well."""
    b = F.floor(F.col(at) / width)
    return rows.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1)) if spread else b)


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, left_id: str, right_id: str, reach: int) -> DataFrame:
    """Each left row with the nearest right row of its key within reach, if any: an equi-join on time buckets."""
    near = bucketed(left, at, reach, False).join(bucketed(right, other_at, reach, True), [key, "bucket"]).where(F.abs(F.col(at) - F.col(other_at)) <= reach)
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(F.abs(F.col(at) - F.col(other_at)), right_id))
    best = near.withColumn("rank", rank).where("rank = 1").select(left_id, right_id, (F.col(other_at) - F.col(at)).alias("apart"))
    return left.select(left_id).join(best, left_id, "left")


def within(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, reach: int) -> DataFrame:
    """All pairs of a key no further apart than reach, by an equi-join on time buckets."""
    return bucketed(left, at, reach, False).join(bucketed(right, other_at, reach, True), [key, "bucket"]).where(F.abs(F.col(at) - F.col(other_at)) <= reach).drop("bucket")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, other_lo: str, other_hi: str) -> DataFrame:
    """All pairs of a key whose closed intervals of whole numbers share a point, each once: an equi-join on dyadic bins.

    An interval is at home at the level whose bins are just wider than it, so it lies in one or two of them; it is a guest in the bins of
    every higher level at which the other side has intervals at home. A pair meets at the higher of its two levels, where one of
    the two is at home (guests never meet guests), and counts in the bin in which its common part begins. A row becomes one or two
    for each level, and there are 64 levels at most, however long intervals are. Intervals that end before they begin, or have a
    NULL end, meet nothing; other columns of both sides must have different names."""

    def level(a: str, b: str) -> Column:
        return F.when(F.col(b) > F.col(a), F.length(F.bin(F.col(b).cast("long") - F.col(a).cast("long")))).otherwise(0)

    def levels(rows: DataFrame) -> DataFrame:
        return rows.select("_level").distinct().agg(F.sort_array(F.collect_list("_level")).alias("_levels"))  # one row of 64 numbers at most

    def binned(rows: DataFrame, a: str, b: str, at: Column) -> DataFrame:
        """Rows with the bins of the levels in an array."""
        rows = rows.withColumn("_at", F.explode(at))
        return rows.withColumn("_bin", F.explode(F.expr(f"array_distinct(array(shiftright(cast({a} AS BIGINT), _at), shiftright(cast({b} AS BIGINT), _at)))")))

    left, right = (rows.where(F.col(b) >= F.col(a)).withColumn("_level", level(a, b)) for rows, a, b in ((left, lo, hi), (right, other_lo, other_hi)))
    home = F.array("_level")

    def guests(rows: DataFrame, others: DataFrame, a: str, b: str, least: int) -> DataFrame:
        rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(levels(others).withColumn("_one", F.lit(1))), "_one").drop("_one")
        return binned(rows, a, b, F.filter("_levels", lambda x: x >= F.col("_level") + least)).drop("_levels")

    same = [*keys, "_at", "_bin"]
    pairs = binned(left, lo, hi, home).drop("_level").join(guests(right, left, other_lo, other_hi, 0).drop("_level"), same)
    pairs = pairs.unionByName(guests(left, right, lo, hi, 1).drop("_level").join(binned(right, other_lo, other_hi, home).drop("_level"), same))
    shares = (F.col(lo) <= F.col(other_hi)) & (F.col(other_lo) <= F.col(hi))
    return pairs.where(shares & (F.col("_bin") == F.expr(f"shiftright(greatest(cast({lo} AS BIGINT), cast({other_lo} AS BIGINT)), _at)"))).drop("_at", "_bin")


def stepped(rows: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """Rows with what lies between each and the one before it along keys (NULL for the first), by blocks of rows."""
    near = frames.haloed(frames.numbered(rows, keys, at), 1)
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*keys, "_block").orderBy("i"))
    return near.withColumn(out, step).where("_home").drop("_block", "_home", "n")


def sessions(rows: DataFrame, key: str, at: str, tie: str, gap: int, size: int = scans.BLOCK) -> DataFrame:
    """Numbers the sessions of each key from 0; one ends before a gap of more than ``gap``. Gaps are found and counted in two levels."""
    placed = scans.placed(rows, [key], [F.col(at), F.col(tie)], size=size)
    opened = scans.scanned(placed, [key], _p=scans.previous(F.col(at))).withColumn("_opens", F.coalesce((F.col(at) - F.col("_p.v") > gap).cast("int"), F.lit(0))).drop("_p")
    return scans.unplaced(scans.scanned(opened, [key], session=scans.Scan("sum", F.col("_opens"))).drop("_opens"))


def fill_gaps(rows: DataFrame, key: str, place: str, value: str, most: int, size: int = scans.BLOCK) -> DataFrame:
    """Rows between members up to ``most`` places apart, by linear interpolation, marked interpolated. A gap is filled from the row that
    ends it, to which the row before was carried."""
    placed = scans.placed(rows.select(key, place, value), [key], [F.col(place)], [F.col(value)], size)
    ends = scans.scanned(placed, [key], _p=scans.previous(F.struct(place, value))).withColumn("_p", F.col("_p.v"))
    apart = F.col(place) - F.col(f"_p.{place}")
    gaps = ends.where((apart > 1) & (apart <= most)).withColumn("p", F.explode(F.sequence(F.col(f"_p.{place}") + 1, F.col(place) - 1)))
    share = (F.col("p") - F.col(f"_p.{place}")) / apart
    made = gaps.select(key, F.col("p").alias(place), (F.col(f"_p.{value}") + (F.col(value) - F.col(f"_p.{value}")) * share).alias(value), F.lit(True).alias("interpolated"))
    return placed.select(key, place, value, F.lit(False).alias("interpolated")).unionByName(made)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group of keys."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")


def retained(rows: DataFrame, at: str, keep: int) -> DataFrame:
    """Rows no older than ``keep`` before the latest row."""
    latest = rows.agg(F.max(at).alias("latest"))
    return rows.join(F.broadcast(latest), F.col(at) >= F.col("latest") - keep).drop("latest")  # one row


def replace_range(rows: DataFrame, new: DataFrame, at: str, lo: int, hi: int) -> DataFrame:
    """rows with all of lo..hi taken out and the rows of new put in."""
    return rows.where(~F.col(at).between(lo, hi)).unionByName(new)


def supported(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least so many."""
    return rows.withColumn("support", F.count("*").over(Window.partitionBy(*keys))).where(F.col("support") >= least)
