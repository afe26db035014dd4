"""Streams against whole tables: tracks kept as state, rows late and repeated, windows by event time."""

import random

from pyspark.sql import functions as F

from profilion.operators import track
from profilion.plans import streams
from profilion.sources.store import Table
from profilion.streaming import ingest, tracks, windows

#: Streams begin at a watermark of 1970: rows no later than that are late.
MINUTE, START = 60_000_000, 1_756_080_000_000_000
SCHEMA = "site string, t long, type string, base double, top double"


def layers(n, seed=1):
    """Detections of two sites and types that cross, come and go, with gaps longer than a session's, and some without a height."""
    r = random.Random(seed)
    rows, t = [], 0
    for _ in range(n):
        t += r.choice([1, 1, 1, 2, 7, 40]) * MINUTE
        for site in ("a", "b"):
            for kind in ("haze", "mixing_layer"):
                for _ in range(r.choice([0, 1, 2, 3])):
                    base = r.uniform(0, 900)
                    rows.append((site, t, kind, base, None if r.random() < 0.1 else base + r.uniform(10, 90)))
    return rows


def test_tracks_of_a_stream_are_those_of_the_table(spark, tmp_path):
    s = track.Settings(jump=120.0, gap=1200.0)
    rows = layers(60)
    table = spark.createDataFrame(rows, SCHEMA)
    wanted = sorted(map(str, track.assigned(table, s).select("site", "t", "type", "base", "top", "track").collect()))
    assert len({x.rsplit("track=", 1)[1] for x in wanted}) > 20
    part = F.pmod(F.xxhash64("t"), F.lit(3))
    end = spark.createDataFrame([("a", rows[-1][1] + 100_000 * MINUTE, None, None, None)], SCHEMA)
    out = str(tmp_path / "out")
    streams.played([table.where(part == 2), table.where(part == 0), table.where(part == 1).unionByName(end)], lambda stream, checkpoint: streams.sunk(tracks.tracked(stream, "30 days", s), checkpoint, out))
    found = spark.read.parquet(out).select("site", "t", "type", "base", "top", "track")
    assert sorted(map(str, found.collect())) == wanted


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    """A row later than the delay does not change what has been given out."""
    rows = spark.createDataFrame([("a", START + k * MINUTE, "haze", 100.0 + k, None) for k in range(30)], SCHEMA)
    late = spark.createDataFrame([("a", START + MINUTE, "haze", 900.0, None), ("a", START + 10_000 * MINUTE, None, None, None)], SCHEMA)
    out = str(tmp_path / "out")
    streams.played([rows, late], lambda stream, checkpoint: streams.sunk(tracks.tracked(stream, "2 minutes"), checkpoint, out))
    found = spark.read.parquet(out)
    assert sorted(r.base for r in found.collect()) == [100.0 + k for k in range(30)] and found.select("track").distinct().count() == 1


def test_ingest_is_the_same_in_any_order(spark, tmp_path):
    rows = [(k % 2, START + k * MINUTE, v) for k in range(400) for v in ({k % 7, 3} if k % 5 == 0 else {1})]
    table = spark.createDataFrame(rows, "site long, t long, value long")
    wanted = {(s, t): min(v for a, b, v in rows if (a, b) == (s, t)) for s, t, _ in rows}
    for name, order in (("x", [0, 1, 2, 1]), ("y", [2, 1, 0])):
        kept = Table(spark, str(tmp_path / name), 60 * MINUTE, ["site", "t"], ["site"])
        part = F.pmod(F.xxhash64("t", "value"), F.lit(3))
        streams.played([table.where(part == k) for k in order], lambda stream, checkpoint, kept=kept: ingest.ingest(stream, kept, checkpoint, "30 days"))
        found = kept.rows().collect()
        assert {(r.site, r.t): r.value for r in found} == wanted and len(found) == len(wanted)


def test_late_rows_are_no_part_of_a_closed_bucket(spark, tmp_path):
    rows = spark.createDataFrame([("k", m * MINUTE) for m in (1, 2, 61, 62, 300)], "k string, t long")
    late = spark.createDataFrame([("k", 3 * MINUTE), ("k", 301 * MINUTE), ("k", 5000 * MINUTE)], "k string, t long")
    out = str(tmp_path / "out")
    streams.played([rows, late], lambda stream, checkpoint: streams.sunk(windows.tumbling(stream, ["k"], "t", "1 hour", "10 minutes", F.count("*").alias("n")), checkpoint, out))
    assert sorted((r["from"] // MINUTE, r.n) for r in spark.read.parquet(out).collect()) == [(0, 2), (60, 2), (300, 2)]
