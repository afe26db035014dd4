"""Two-level scans against windows over whole keys, with blocks so small that every key has many."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from profilion.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    made = [(None if i % 7 == 3 else f"k{i % 3 // 2}", i * 37 % 50, None if i % 5 == 2 else i * 13 % 11, i) for i in range(300)]
    return spark.createDataFrame(made, "k string, at long, v long, id long").repartition(5)


@pytest.fixture(scope="module")
def placed(rows):
    return scans.placed(rows, ["k"], ["at"], ["id"], size=4)


def test_places(rows, placed):
    w = Window.partitionBy("k").orderBy("at", "id")
    wanted = {(r.id, r.n) for r in rows.withColumn("n", F.row_number().over(w)).collect()}
    found = scans.scanned(placed, ["k"], n=scans.Scan("sum", F.lit(1)))
    assert {(r.id, r.n) for r in found.collect()} == wanted
    assert placed.groupBy("_block").count().agg(F.max("count")).first()[0] == 4
    assert scans.blocks(placed, ["k"]).agg(F.max("_blocks")).first()[0] > 10


@pytest.mark.parametrize("before", [False, True])
def test_running_values(rows, placed, before):
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    kinds = {"sum": F.sum("v"), "xor": F.bit_xor("v"), "min": F.min("v"), "max": F.max("v"), "last": F.last("v", ignorenulls=True)}
    wanted = rows.select("id", *[c.over(w).alias(k) for k, c in kinds.items()])
    found = scans.scanned(placed, ["k"], **{k: scans.Scan(k, F.col("v"), before) for k in kinds}).select("id", *kinds)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_previous_and_seen(rows, placed):
    w = Window.partitionBy("k").orderBy("at", "id")
    wanted = rows.withColumn("x", F.coalesce("v", F.lit(-1)))
    wanted = wanted.select("id", F.lag("v").over(w).alias("p"), (F.row_number().over(Window.partitionBy("k", "x").orderBy("at", "id")) > 1).alias("s"))
    found = scans.scanned(placed, ["k"], p=scans.previous(F.col("v"))).withColumn("x", F.coalesce("v", F.lit(-1)))
    found = scans.seen(found, ["k"], "x", "s").select("id", F.col("p.v"), "s")
    key = lambda r: r[0]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)


def test_no_rows(rows):
    empty = scans.placed(rows.limit(0), ["k"], ["at"])
    assert scans.scanned(empty, ["k"], n=scans.Scan("sum", F.lit(1))).count() == 0


def test_overlapping(spark):
    """Each pair of intervals of any length once, also those of a single point, against all pairs."""
    import random

    from profilion.operators import temporal

    r = random.Random(2)

    def made(n, names):
        rows = []
        for i in range(n):
            lo = r.randrange(-500, 500)
            rows.append((i, r.choice(["a", "b", None]), None if r.random() < 0.05 else lo, lo + r.choice([-1, 0, 0, 1, 3, 15, 16, 40, 700])))
        return rows, spark.createDataFrame(rows, names)

    left, a = made(120, "i long, k string, lo long, hi long")
    right, b = made(150, "j long, k string, lo2 int, hi2 int")
    wanted = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] is not None and None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    found = temporal.overlapping(a, b, ["k"], "lo", "hi", "lo2", "hi2")
    assert sorted((p.i, p.j) for p in found.collect()) == wanted
    assert found.columns.count("k") == 1
    assert temporal.overlapping(a.limit(0), b, ["k"], "lo", "hi", "lo2", "hi2").count() == 0
