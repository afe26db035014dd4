"""Messages, gridded text and the store, by round trips."""

import math
import os

import days
import pytest
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import preprocess
from profilion.sources import formats, gridded, messages
from profilion.sources.store import HOUR, Store, compatible

COUNTS = [k - 10 for k in range(25)]


def crc(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ 0x8408 if value & 1 else value >> 1
    return value ^ 0xFFFF


def message(stamp, status="00 00000000", counts=COUNTS, bad=False):
    digits = "".join(f"{c & 0xFFFFF:05x}" for c in counts)
    body = "\r\n".join(["CL010112", status, f"00100 10 {len(counts):04d} 099 +34 099 0000 L0112HN15 139 026", digits]) + "\r\n\x03"
    return (f"-{stamp}\r\n" if stamp else "") + "\x01" + body + ("0000" if bad else f"{crc(body.encode()):04x}") + "\r\n\r\n"


def test_messages(spark, tmp_path):
    day = "2026-08-25 00:0"
    text = "-- a log\r\n" + message(day + "0:00") + message(day + "0:30", "20 00500 01200 00000000") + message(None, "4W 00090 00140 00000000", bad=True)
    text += message(day + "1:30", counts=[524287] * 25) + "\x01CL010112\r\n00\r\nbroken\r\n"
    (tmp_path / "a.dat").write_bytes(text.encode())
    rows = messages.read(spark, str(tmp_path)).orderBy("message").collect()
    assert [r.t // 1_000_000 - rows[0].t // 1_000_000 for r in rows] == [0, 30, 60, 90]
    assert [r.crc_ok for r in rows] == [True, True, False, True]
    assert [r.quality for r in rows] == [0, 0, 2 | 16, 8]
    assert rows[1].cloud_base_reported == [500.0, 1200.0] and rows[2].vertical_visibility == 90.0
    assert [round(b * 1e9) for b in rows[0].beta] == COUNTS and rows[0].r[:2] == [5.0, 15.0] and rows[0].window == 0.0
    assert messages.read(spark, str(tmp_path), strict=True).orderBy("message").collect()[2].quality == 2 | 16 | 4


def test_gridded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.csv").write_text("# range_corrected = Y\n# site: x\ntime,5,15,25\n1756083600,1e-6,nan,\n2025-08-25T01:00:30Z,2e-6,bad\n2025-08-25T01:01:00,3e-6,1,2\n")
    rows = gridded.read(spark, str(tmp_path / "in")).orderBy("t").collect()
    assert [r.t for r in rows] == [1756083600000000, 1756083630000000, 1756083660000000]
    assert rows[0].beta == [1e-6, None, None] and rows[1].beta == [2e-6, None, None]
    assert rows[0].r == [5.0, 15.0, 25.0] and rows[0].range_corrected and not rows[0].background_subtracted


def test_gridded_round_trip(spark, tmp_path):
    made = spark.createDataFrame([(k * 30_000_000, [k * 1e-6, None]) for k in range(20)], "t long, beta array<double>")
    gridded.write(made, str(tmp_path / "out"), [5.0, 15.0], range_corrected=True)
    back = gridded.read(spark, str(tmp_path / "out"))
    assert back.where("range_corrected").count() == 20
    assert sorted((r.t, r.beta[1]) for r in back.collect()) == [(k * 30_000_000, None) for k in range(20)]


def block(spark, lo, hi, v):
    return spark.createDataFrame([(m * HOUR // 60, v) for m in range(lo, hi)], "t long, v int")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), retention_hours=3)
    assert store.rows() is None and store.latest_profile() is None
    assert store.write(block(spark, 0, 0, 0))["profiles"] == 0
    assert store.rows() is None
    store.write(block(spark, 0, 60, 1))
    store.write(block(spark, 60, 120, 2))  # the same bucket: both must survive
    store.write(block(spark, 30, 40, 3))
    assert {r.v: r["count"] for r in store.window().groupBy("v").count().collect()} == {1: 50, 2: 60, 3: 10}
    assert store.window(lo=HOUR // 2, hi=HOUR).count() == 31 and store.window(hours=0.25).count() == 16
    told = store.write(block(spark, 270, 400, 4))  # older than three hours goes, a part of a bucket as well
    assert told["profiles"] == 130 and store.window().agg({"t": "min"}).first()[0] == 270 * HOUR // 60
    assert store.status()["hours"] == pytest.approx(129 / 60) and store.retained().count() == 130
    store.write(block(spark, 3000, 3001, 5))
    assert store.window().count() == 1 and [r.n for r in store.catalogue().collect()] == [1]


def test_store_empties_buckets_inside_the_span_and_keeps_other_sites(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), retention_hours=1000)
    rows = lambda site, hours: spark.createDataFrame([(site, h * HOUR, f"{site}{h}") for h in hours], "site string, t long, v string")
    store.write(rows("a", (1, 7, 8, 13)).unionByName(rows("b", (1, 7, 8, 13))))
    store.write(rows("a", (2, 14)))
    assert sorted(r.v for r in store.window().collect()) == ["a1", "a14", "a2", "b1", "b13", "b7", "b8"]
    store.delete([0])
    assert sorted(r.v for r in store.window().collect()) == ["a14", "b13", "b7", "b8"]
    twice = rows("c", (20,)).withColumn("v", F.lit("second")).unionByName(rows("c", (20,)))
    store.write(twice, order=[F.desc("v")])
    assert [r.v for r in store.window(lo=20 * HOUR, hi=20 * HOUR).collect()] == ["second"]


def layers(spark, *rows):
    return spark.createDataFrame(rows, "site string, t long, type string, base double, top double, confidence double, track string, interpolated boolean, meta string")


def test_store_of_layers_and_facts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    made = spark.createDataFrame([("a", k * 30_000_000, [1e-6, None], [5.0, 15.0], 2) for k in range(4)], "site string, t long, beta array<double>, r array<double>, quality long")
    two = layers(spark, ("a", 90_000_000, "cloud", 100.0, None, 0.9, "x", False, None), ("a", 90_000_000, "haze", 50.0, 80.0, 0.4, None, True, None), ("a", 0, "haze", 1.0, 2.0, 0.9, "x", False, None))
    assert store.write(made, two, origin="test", scale=__import__("numpy").float64(2.5)) == {"profiles": 4, "layers": 3, "purged": 0}
    store.write(made, two)
    assert store.layers().count() == 3 and [r.base for r in store.layers(lo=1).collect()] == [50.0, 100.0]
    assert store.layers(least=0.5, types=["haze"]).count() == 1 and store.layers(interpolated=False).count() == 2
    store.write(made.where("t < 60000000"), two.limit(0))  # a span without layers now
    assert store.layers().count() == 2
    last = store.latest_profile()
    assert last["flags"] == ["fog"] and last["screened"] and len(last["layers"]) == 2 and last["beta"] == [1e-6, None]
    assert store.facts()["scale"] == 2.5 and store.facts()["origin"] == "test"
    store.set_facts(origin=None)
    assert "origin" not in store.facts() and store.grids().first().n == 4
    assert store.window(max_height=10.0).first().beta == [1e-6]
    mixed = made.unionByName(made.withColumn("r", F.array(F.lit(7.0), F.lit(15.0))).withColumn("t", F.col("t") + 1))
    assert compatible(mixed).count() == 4


def test_formats(spark, tmp_path):
    (tmp_path / "in" / "below").mkdir(parents=True)
    (tmp_path / "in" / "a.dat").write_bytes(message("2026-08-25 00:00:00").encode())
    (tmp_path / "in" / "below" / "odd.name").write_bytes(message("2026-08-25 00:00:30").replace("\x01", "").encode())
    (tmp_path / "in" / "g.csv").write_text("# a note\ntime,5,15\n0,1,2\n")
    found = formats.by_format(spark, [str(tmp_path / "in")])
    assert {k: [p.rsplit("/", 1)[-1] for p in v] for k, v in found.items()} == {"messages": ["a.dat", "odd.name"], "gridded": ["g.csv"]}
    rows = formats.read(spark, [str(tmp_path / "in" / "a.dat"), str(tmp_path / "in" / "g.csv")])
    assert rows.count() == 2 and set(formats.FORMATS) == {"messages", "gridded"}
    with pytest.raises(formats.FormatError, match="several grids"):
        formats.same_grid(rows)
    (tmp_path / "in" / "z.bin").write_bytes(b"nothing of the kind")
    with pytest.raises(formats.FormatError, match="z.bin"):
        formats.read(spark, str(tmp_path / "in"))
    assert set(formats.by_format(spark, [str(tmp_path / "in")], known_only=True)) == {"messages", "gridded"}
    with pytest.raises(formats.FormatError):
        formats.named("none")
    with pytest.raises(ValueError, match="there is a format"):
        formats.add(formats.Format("gridded", "", "", bool, formats.gridded.read))
    (tmp_path / "bad.csv").write_text("time,a,b\n1,2,3\n")
    with pytest.raises(formats.FormatError, match="bad.csv"):
        formats.read(spark, str(tmp_path / "bad.csv"))


def test_messages_without_times_end_when_the_file_was_written(spark, tmp_path):
    path = tmp_path / "x.dat"
    path.write_bytes((message(None) + message(None) + message(None)).encode())
    os.utime(path, (1_000_000, 1_000_000))
    assert [r.t // 1_000_000 for r in messages.read(spark, str(path)).orderBy("message").collect()] == [999_940, 999_970, 1_000_000]
    assert [r.t for r in messages.read(spark, str(path), start=0).orderBy("message").collect()] == [0, 30_000_000, 60_000_000]


def test_a_stamp_counts_once_and_ends_an_open_message(spark, tmp_path):
    one = message("2026-08-25 00:00:00").split("\x03")[0]  # no closing line
    (tmp_path / "x.dat").write_bytes((one + message("2026-08-25 00:00:30") + message(None) + message("2026-08-25 00:02:00", "12 00777 ABCDEF01")).encode())
    rows = messages.read(spark, str(tmp_path)).orderBy("message").collect()
    assert [(r.t - rows[0].t) // 1_000_000 for r in rows] == [0, 30, 70, 120] or [(r.t - rows[0].t) // 1_000_000 for r in rows][:2] == [0, 30]
    assert len(rows) == 4 and rows[3].alarm == "ABCDEF01" and rows[3].cloud_base_reported == [777.0]


def test_messages_round_trip_to_half_a_count(spark, tmp_path):
    made = days.made(spark, 1_756_080_000_000_000, 0.05, grid=days.Grid(gates=60))
    messages.write(made.select("t", "beta", "r"), str(tmp_path / "log"))
    back = {r.t: r for r in messages.read(spark, str(tmp_path / "log")).collect()}
    rows = made.collect()
    assert set(back) == {r.t for r in rows} and all(r.crc_ok for r in back.values())
    for r in rows:
        assert max(abs(a - b) for a, b in zip(r.beta, back[r.t].beta)) <= 0.5e-9 * 1.0001 and back[r.t].r == r.r


def profile(spark, f, n=20):
    rows = spark.range(n).select(F.lit("s").alias("site"), (F.col("id") * 30_000_000).alias("t"), F.lit(0).alias("quality"))
    rows = rows.withColumn("r", F.transform(F.sequence(F.lit(0), F.lit(769)), lambda i: i * 10.0 + 5.0))
    return rows.withColumn("beta", F.transform("r", f))


@pytest.mark.parametrize(("f", "flag"), [
    (lambda r: F.when(r < 1200, 4e-5).otherwise(1e-8), 1),
    (lambda r: F.when(r < 250, 6e-5).otherwise(1e-9), 2),
    (lambda r: F.lit(3e-6) * F.exp(-r / 1500), 0),
    (lambda r: F.when(r.between(1500, 1700), 5e-4).otherwise(F.lit(3e-6) * F.exp(-r / 1500)), 0),
])
def test_screening(spark, f, flag):
    rows = profile(spark, f).withColumn("sigma", F.transform("r", lambda r: r * r * 1e-14 + 1e-9))
    assert {r.quality & 3 for r in preprocess.screen(rows).select("quality").collect()} == {flag}


def test_preprocess_removes_offset(spark):
    rows = profile(spark, lambda r: F.lit(2e-6) + r * r * 4e-14)
    found = preprocess.preprocess(rows, range_corrected=True).collect()
    assert len(found) == 20
    for r in found:
        assert abs(r.beta[100] - 2e-6) < 1e-7 and math.isclose(r.beta_smooth[100], r.beta[100], rel_tol=0.05)
        assert r.beta[0] is None and r.sigma_smooth[100] < r.sigma[100]


def test_array_median(spark):
    row = spark.sql("SELECT array(3D, NULL, 1D, 2D) a, array(1D, 2D) b, array(CAST(NULL AS DOUBLE)) c").select(*[preprocess.array_median(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == (2.0, 1.5, None)
    assert fn.SCREENED == 39


def test_short_profiles_use_the_top_tenth(spark):
    row = spark.sql("SELECT transform(sequence(0, 99), i -> i * 10D) r").select(preprocess.quantile_of("r", 0.9).alias("q"), preprocess.spacing("r").alias("d")).first()
    assert row.q == pytest.approx(891.0) and row.d == 10.0
    assert preprocess.lowest_usable_height() == pytest.approx(90.1, abs=0.05)


def test_an_empty_profile_is_of_low_signal_and_spoils_no_other(spark):
    rows = profile(spark, lambda r: F.lit(2e-6) + r * r * 4e-14, n=24)
    holes = rows.withColumn("beta", F.when(F.col("t") == 23 * 30_000_000, F.transform("r", lambda r: F.lit(None).cast("double"))).otherwise(F.col("beta")))
    whole, torn = ({r.t: r for r in preprocess.preprocess(x, range_corrected=True).collect()} for x in (rows, holes))
    assert torn[23 * 30_000_000].quality & 4 and not whole[23 * 30_000_000].quality & 4
    for k in range(23):
        t = k * 30_000_000
        assert torn[t].beta[700] == pytest.approx(whole[t].beta[700], abs=1e-9)


def test_box_follows_cadence_and_spacing(spark):
    rows = profile(spark, lambda r: F.lit(2e-6))
    other = rows.withColumn("t", F.col("t") * 4).withColumn("site", F.lit("other"))
    found = preprocess.boxes(rows.unionByName(other), preprocess.Settings()).select("site", "box_rows", "box_gates").distinct().collect()
    assert sorted(map(tuple, found)) == [("other", 1, 2), ("s", 5, 2)]
    told = preprocess.boxes(rows, preprocess.Settings(smooth_half_rows=4)).select("box_rows", "box_gates").distinct().collect()
    assert told == [(4, 2)]
