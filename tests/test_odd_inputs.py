"""Queries on inputs that the given tables do not have: long spans, rows in plenty, means near a border."""

import os
import time

import duckdb
import pyarrow as pa
import pytest
from oracle import TABLES, expected, same
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from profilion.operators import aggregates, detect, track
from profilion.plans import catalog, cores, domain, streams  # noqa: F401
from profilion.streaming import tracks

MINUTE = 60_000_000


def replaced(folder, sf_dir, name, sql):
    """The given tables, but one of them made by SQL."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    duckdb.sql(f"COPY ({sql.format(table=f'{sf_dir}/{name}.parquet')}) TO '{folder / name}.parquet'")
    return str(folder)


#: Nine times whose mean is just short of, or just at, a whole millisecond, and comes out on the other side if doubles are added.
BORDER = [1709571508785369, 1709572142523953, 1709574898005562, 1709573396649732, 1709571680380151, 1709571515493572, 1709572623523447, 1709571526540502, 1709572855738710]


def test_means_of_times_are_exact(spark, sf_dir, tmp_path):
    rows = spark.createDataFrame([(t,) for t in BORDER], "t long")
    assert rows.agg(aggregates.mean_of_whole("t").alias("m")).first().m == sum(BORDER) / len(BORDER)
    assert [x.agg(aggregates.mean_of_whole("t").alias("m")).first().m for x in (rows.where("t < 0"), spark.createDataFrame([(-3,), (-4,), (None,)], "t long"))] == [None, -3.5]
    many = spark.range(20_000).select((F.col("id") % 2 + BORDER[0]).alias("t"))  # their sum does not fit into 64 bits
    assert many.agg(aggregates.mean_of_whole("t").alias("m")).first().m == BORDER[0] + 0.5
    values = ", ".join(f"({k}, {t})" for k, t in enumerate(BORDER))
    folder = replaced(tmp_path, sf_dir, "events", f"SELECT k::BIGINT AS event_id, make_timestamp(t::BIGINT) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value, '' AS props FROM (VALUES {values}) v(k, t)")
    same(catalog.QUERIES["downsample_row_bucket"](spark, folder).toPandas(), expected(catalog.ORACLES["downsample_row_bucket"], folder))


def test_one_detection_at_a_time_costs_little(spark):
    """A session of 40,000 times is one task; a frame of its own for each of them took minutes."""
    rows = spark.range(40_000).select(F.lit("a").alias("site"), (F.col("id") * MINUTE).alias("t"), F.lit("haze").alias("type"), (F.col("id") % 100 * 1.0).alias("base"), F.lit(None).cast("double").alias("top"))
    began = time.monotonic()
    found = track.assigned(rows, track.Settings(jump=1e9)).agg(F.count("*").alias("n"), F.min("track").alias("lo"), F.max("track").alias("hi")).first()
    assert time.monotonic() - began < 40 and tuple(found) == (40_000, "a:haze:0:0", "a:haze:0:0")


@pytest.mark.parametrize("height", [50.0, 450.0])
def test_a_single_detection_is_assigned_as_one_of_many(height):
    s = track.Settings(jump=100.0, jump_per_minute=0.0)
    active = [track.Active([[0, 0, 0.0], [1, 0, 100.0], [2, 0, 300.0]], 0, 0, 3) for _ in range(2)]
    wanted = active[0].take(MINUTE, track.np.array([height, 5000.0]), s)[0]
    assert active[1].take_one(MINUTE, height, s) == wanted == (0 if height == 50.0 else 3)


class Handle:
    """What the tracker asks of its state, in memory, and how many timers it sets."""

    def __init__(self):
        self.timers, self.set = set(), 0

    def getMapState(self, *_):  # noqa: N802
        kept = {}
        return type("Map", (), {"containsKey": lambda _, k: k in kept, "getValue": lambda _, k: kept.get(k), "updateValue": lambda _, k, v: kept.__setitem__(k, v), "removeKey": lambda _, k: kept.pop(k)})()

    def getListState(self, *_):  # noqa: N802
        kept = []
        return type("List", (), {"exists": lambda _: bool(kept), "get": lambda _: list(kept), "put": lambda _, v: kept.__setitem__(slice(None), v), "appendValue": lambda _, v: kept.append(v), "clear": lambda _: kept.clear()})()

    def getValueState(self, *_):  # noqa: N802
        kept = []
        return type("Value", (), {"exists": lambda _: bool(kept), "get": lambda _: kept[0], "update": lambda _, v: kept.__setitem__(slice(None), [v]), "clear": lambda _: kept.clear()})()

    def registerTimer(self, at):  # noqa: N802
        self.set += 1
        self.timers.add(at)


def test_timers_of_a_stream_go_by_stretches_not_rows():
    """2,880 rows, out of order, in stretches of six hours: a timer for each row called for the state as often."""
    schema = StructType([StructField(c, LongType()) for c in ("site", "t")] + [StructField("type", StringType())] + [StructField(c, DoubleType()) for c in ("base", "top", "_height")])
    tracker, handle = tracks.Tracker(["site", "t", "type", "base", "top"], schema, track.Settings(gap=6 * 3600.0)), Handle()
    tracker.init(handle)
    rows = [Row(site=1, t=(k * 7 % 2880 + 1) * MINUTE, type="haze", base=5.0, top=None, _height=5.0) for k in range(2880)]
    for part in (rows[:1000], rows[1000:]):
        list(tracker.handleInputRows((1, "haze"), iter(part), TimerValues(0, 0)))
    found = []
    for end in (1000 * 60_000, 10_000 * 60_000):  # the watermark stops within a stretch once
        while due := sorted(x for x in handle.timers if x <= end):
            found += tracker.handleExpiredTimer((1, "haze"), TimerValues(0, end), ExpiredTimerInfo(due[0]))
            handle.timers.discard(due[0])
        assert len(found) == min(end // 60_000, 2880)
    assert [r.t for r in found] == [(k + 1) * MINUTE for k in range(2880)] and {(r._began, r._number) for r in found} == {(MINUTE, 0)}
    assert handle.set <= 40 and not tracker.session.exists()


def test_a_window_of_all_that_is_stored(spark, sf_dir, tmp_path):
    """Profiles over 4,000 hours, more than a client's longest window."""
    folder = replaced(tmp_path, sf_dir, "embeddings", "SELECT * REPLACE (vec_id * 1000 AS vec_id) FROM '{table}'")
    same(catalog.QUERIES["window_payload"](spark, folder).toPandas(), expected(catalog.ORACLES["window_payload"], folder))


def test_no_query_hides_another_of_its_name(spark, sf_dir):
    """A second screened_smooth, on flags that it was given, stood in the place of the one that screens."""
    with pytest.raises(ValueError, match="screened_smooth"):
        catalog.query()(catalog.screened_smooth)
    for name, columns in (("screened_smooth", {"vec_id", "gate", "beta_smooth", "sigma_smooth", "quality"}), ("smooth_flagged", {"vec_id", "gate", "mean", "error", "thin"})):
        found = catalog.QUERIES[name](spark, sf_dir).toPandas()
        assert set(found.columns) == columns
        same(found, expected(catalog.ORACLES[name], sf_dir))


def test_edges_are_found_in_small_parts(spark, sf_dir):
    """A batch of 2,500 profiles, several parts long: edges are those that each profile has in a batch of its own vectors."""
    holes = detect.gates_of(pa.array([[1.0, None], None, [], [3.0, 4.0]], pa.list_(pa.float64())).slice(0, 4))
    assert [str(x) for x in holes] == ["[ 1. nan]", "[]", "[]", "[3. 4.]"] and detect.PROFILES < 1000
    rows = domain.flat(spark, sf_dir).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("t", F.col("t") + F.col("_k") * 1_000_000).drop("_k").coalesce(1)
    s = detect.Settings(scales=(40.0, 80.0), lowest=90.0, highest=550.0, significance=0.3)
    found = detect.candidates(rows, s).select((F.col("t") % 1_000_000).alias("t"), F.to_json("candidates").alias("x"))
    assert found.groupBy("t").agg(F.countDistinct("x").alias("n"), F.count("x").alias("m")).where("n <> 1 OR m <> 5").isEmpty()
