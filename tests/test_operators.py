from pyspark.sql import functions as F

from profilion.operators import frames, temporal


def table(spark, values, key=1):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k long, i long, v double")


def test_unit_step_peaks_at_a_half(spark):
    rows = frames.haar(table(spark, [1.0] * 20 + [0.0] * 20), "k", "i", "v", 4)
    best = rows.orderBy(F.desc("w")).first()
    assert abs(best["w"] - 0.5) < 1e-9 and best["i"] == 20


def test_gaps_reach_just_as_far_as_the_window(spark):
    values = [1.0] * 60
    values[30:33] = [None] * 3
    rows = frames.haar(table(spark, values), "k", "i", "v", 4).where("w IS NULL").select("i").toPandas()["i"]
    assert sorted(rows) == [*range(4), *range(27, 37), *range(57, 60)]


def test_extrema_need_both_neighbours(spark):
    got = frames.local_extrema(table(spark, [0.0, 1.0, 0.0, None, 5.0, None, 0.0]), "k", "i", "v").collect()
    assert [r["i"] for r in got] == [1]


def test_fill_depth_stops_at_the_first_long_gap(spark):
    rows = table(spark, [1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    assert frames.fill_depth(rows, "k", "i", F.col("v") > 0, 2).first()["last"] == 4


def test_sessions_and_gaps(spark):
    rows = spark.createDataFrame([(1, t, t * 1.0) for t in (0, 5, 30, 31)], "k long, t long, v double")
    assert [r["session"] for r in temporal.sessions(rows, "k", "t", "t", 10).orderBy("t").collect()] == [0, 0, 1, 1]
    filled = temporal.fill_gaps(rows.where("t <> 5"), "k", "t", "v", 40).where("interpolated")
    assert filled.count() == 29 and filled.where("abs(v - t) > 1e-9").isEmpty()


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert frames.islands(none, "k", "i", F.col("v") > 0).isEmpty()
    assert temporal.retained(none, "i", 5).isEmpty()
