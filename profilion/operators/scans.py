"""Scans along keys in two levels, so that no task holds a key.

Rows are range-sorted by key and order and cut into blocks (``placed``). Each block is summarised, the summaries are scanned, and
what lies before a block is joined back to its rows. Blocks follow the order of the whole table, so at most one key goes on from
one block into the next: what is joined back has at most one row for each block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilion.session import settle

#: Rows of a block; ``monotonically_increasing_id`` leaves so many bits to the rows of a partition.
BLOCK, PARTITION_BITS = 8192, 33


def placed(rows: DataFrame, keys: list[str], order: list, ties: list = [], size: int = BLOCK, keep: list[str] | None = None) -> DataFrame:  # noqa: B006
    """Rows sorted by keys, order and ties, with _row, which grows in that order over the whole table, and _block, the stretch of
    at most ``size`` rows that a row lies in. Ties count within a partition only: rows that differ in nothing else are not taken
    apart. The table (of columns ``keep``, if given) is settled, so that places do not change when a task is run again."""
    keyed = [F.col(k) for k in keys]
    found = rows.repartitionByRange(*keyed, *order).sortWithinPartitions(*keyed, *order, *ties).withColumn("_row", F.monotonically_increasing_id())
    found = found.select(*keep, "_row") if keep else found
    part = F.shiftright("_row", PARTITION_BITS)
    within = F.col("_row") - F.shiftleft(part, PARTITION_BITS)
    return settle(found.withColumn("_block", F.shiftleft(part, PARTITION_BITS) + F.floor(within / size)))


#: Of each kind: the aggregate, and how what came before a block joins what came within.
KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


@dataclass(frozen=True)
class Scan:
    """A running value: its kind, the expression that runs, and whether the row itself is left out."""

    kind: str
    value: Column
    before: bool = False


def blocks(rows: DataFrame, keys: list[str], **summaries: Column) -> DataFrame:
    """One row for each key and block of placed rows: what the block holds, and _blocks, how many blocks its key has."""
    found = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), *[c.alias(name) for name, c in summaries.items()])
    return found.withColumn("_blocks", F.count("*").over(Window.partitionBy(*keys)))


def scanned(rows: DataFrame, keys: list[str], **scans: Scan) -> DataFrame:
    """Placed rows with running values along their keys, each under its name."""

    def whole(scan: Scan) -> Column:
        value = scan.value
        return F.max_by(value, F.when(value.isNotNull(), F.col("_row"))) if scan.kind == "last" else KINDS[scan.kind][0](value)

    def held(name: str) -> str:
        return f"_before_{name}"

    summed = rows.groupBy(*keys, "_block").agg(*[whole(s).alias(held(n)) for n, s in scans.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_block"))
    carries = summed.select(F.col("_block").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in keys], place.alias("_place"), *[KINDS[s.kind][0](held(n)).over(earlier).alias(held(n)) for n, s in scans.items()])
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = rows.join(carries.where("_place > 1").drop("_place"), same, "left")
    w = Window.partitionBy(*keys, "_block").orderBy("_row")
    for name, s in scans.items():
        within = KINDS[s.kind][0](s.value).over(w.rowsBetween(Window.unboundedPreceding, -1 if s.before else 0))
        joined = joined.withColumn(name, KINDS[s.kind][1](F.col(held(name)), within))
    return joined.drop("_at", *[f"_key_{k}" for k in keys], *[held(n) for n in scans])


def told(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """Placed rows with the further columns of their key's row in a table of one row a key at most, NULLs where there is none. The
    table meets the key's blocks first, and these their rows, so the rows of a large key are not brought together."""
    more = [c for c in table.columns if c not in keys]
    pairs = rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_at")).distinct()
    wanted = table.select(*[F.col(k).alias(f"_fact_{k}") for k in keys], *more)
    same, here = F.lit(True), F.col("_block") == F.col("_at")
    for k in keys:
        same = same & F.col(f"_key_{k}").eqNullSafe(F.col(f"_fact_{k}"))
        here = here & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    pairs = pairs.join(wanted, same).drop(*[f"_fact_{k}" for k in keys])
    return rows.join(pairs, here, "left").drop("_at", *[f"_key_{k}" for k in keys])


def previous(value: Column) -> Scan:
    """The row before, as a struct with the one field v; NULL at a key's first row, whatever the value is."""
    return Scan("last", F.struct(value.alias("v")), before=True)


def seen(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Placed rows with whether an earlier row of their key has the same value, which must not be NULL."""
    again = F.row_number().over(Window.partitionBy(*keys, "_block", value).orderBy("_row")) > 1
    rows = rows.withColumn("_again", again)
    each = rows.where("NOT _again").select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_at"), F.col(value).alias("_value"))
    first = each.groupBy(*[f"_key_{k}" for k in keys], "_value").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where("_last > _first").drop("_last")
    same = F.col(value) == F.col("_value")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # rows of one value and block but the first are known to be repeats; one row for each block and value meets its first block
    late = rows.where("NOT _again").join(first, same).where("_block > _first").select(F.col("_row").alias("_at"))
    marked = rows.join(late, F.col("_row") == F.col("_at"), "left")
    return marked.withColumn(out, F.col("_again") | F.col("_at").isNotNull()).drop("_again", "_at")


def unplaced(rows: DataFrame) -> DataFrame:
    return rows.drop("_row", "_block")
