"""From generated logs to stored layers and windows; settings; exact percentiles; blocks of rows."""

import json
import struct

import days
import numpy as np
import pytest
from pyspark.sql import functions as F

from profilion import pipeline, settings
from profilion.operators import aggregates, frames, score
from profilion.plans import window
from profilion.sources import messages
from profilion.sources.store import HOUR, Store

START = 1_756_080_000_000_000


@pytest.fixture(scope="module")
def made(spark):
    return days.made(spark, START + 9 * HOUR, 0.5).cache()


def test_ingest_of_logs_scores_well(spark, made, tmp_path):
    bases = F.when(F.col("cloud_base").isNotNull(), F.array("cloud_base")).otherwise(F.array().cast("array<double>"))
    messages.write(made.select("t", "beta", "r", bases.alias("bases")), str(tmp_path / "log"))
    s = settings.Settings(site="made", storage=settings.Storage(str(tmp_path / "store")))
    told = pipeline.ingest(spark, str(tmp_path / "log"), s, known_only=True)
    again = pipeline.ingest(spark, str(tmp_path / "log"), s, known_only=True)
    assert told["profiles"] == 60 and again["types"] == told["types"] and {"cloud", "mixing_layer"} <= set(told["types"])
    store = Store(spark, s.storage.path)
    assert store.layers().count() == told["layers"] and store.status()["gates"] == 770 and store.status()["settings"]["detect"]["significance"] == 3.0
    found = score.feature_scores(store.layers(), made, ["site", "t"]).toPandas().set_index("feature")
    assert found.loc["cloud_base"].detection_rate >= 0.9 and abs(found.loc["cloud_base"].bias) < 75
    assert found.loc["mixing_top"].detection_rate >= 0.85 and found.loc["mixing_top"].within >= 0.85
    text = score.report(score.feature_scores(store.layers(), made, ["site", "t"]), score.screen_scores(store.window(), made, ["site", "t"]))
    assert "cloud_base" in text and "fog" in text

    header, cells = window.assembled(store, window.Request(hours=24, max_rows=16, max_gates=40))
    assert header["shape"] == [15, 39] and header["factors"] == [4, 20] and header["full_shape"] == [60, 770]
    assert set(header["layers"]) == set(told["types"]) and header["percentiles"]["p01"] < header["percentiles"]["p99"]
    frame = window.payload(header, cells, binary=True)
    assert frame[:4] == window.MAGIC and frame[4] == 1
    size = struct.unpack("<I", frame[5:9])[0]
    assert json.loads(frame[9 : 9 + size])["shape"] == [15, 39] and len(frame) == 9 + size + 15 * 39
    assert len(json.loads(window.payload(header, cells))["data"]) >= 15 * 39
    assert window.split_runs(store.layers()).where("run < 1").isEmpty() and not window.latest_layers(store).isEmpty()


def test_window_of_an_empty_store(spark, tmp_path):
    header, cells = window.assembled(Store(spark, str(tmp_path / "none")))
    assert header["shape"] == [0, 0] and cells is None and json.loads(window.payload(header, cells))["data"] == ""


@pytest.mark.parametrize("wrong", [{"hours": 0}, {"hours": 721}, {"max_rows": 15}, {"max_gates": 5001}, {"least": 1.5}, {"vmin": 0.0, "vmax": -1.0}, {"max_height": 0.0}])
def test_requests_out_of_range(wrong):
    with pytest.raises(ValueError, match="out of its range"):
        window.Request(**wrong)


def test_gates_of_the_score():
    class Table:
        def __init__(self, *rows):
            self.rows = rows

        def orderBy(self, _):  # noqa: N802
            return self

        def collect(self):
            return self.rows

    good = {"observable": 10, "detection_rate": 1.0, "bias": 0.0, "within": 1.0, "false_rate": 0.0, "tolerance": 50.0}
    bad = good | {"feature": "haze_top", "detection_rate": 0.5, "bias": 80.0, "within": 0.5, "false_rate": 0.2}
    screens = Table({"screen": "fog", "recall": 0.9, "precision": 0.9})
    assert score.failures(Table(good | {"feature": "cloud_base"}), Table({"screen": "fog", "recall": 1.0, "precision": 0.9})) == []
    assert len(score.failures(Table(bad, good | {"feature": "haze_base", "observable": 0}), screens)) == 6


def test_known_hours_meet_the_gates(spark):
    """Hours with fog, a residual layer and haze: every gate on detection, bias, tolerance, false alarms and screens is met."""
    truth = days.made(spark, START + int(3.5 * HOUR), 2.0, grid=days.Grid(every=60.0)).cache()
    done = pipeline.process(truth.select("site", "t", "r", "beta", "quality", "range_corrected"))
    scores, screens = score.feature_scores(done.layers, truth, ["site", "t"]), score.screen_scores(done.profiles, truth, ["site", "t"])
    assert score.failures(scores, screens) == ["cloud_base: nothing to see"]


def test_two_sites_of_other_cadence_and_grid_in_one_call(spark):
    """Each site's layers are those that it gives alone."""
    one = days.made(spark, START + 5 * HOUR, 0.5, site="a")
    two = days.made(spark, START + 5 * HOUR, 0.5, site="b", grid=days.Grid(gates=400, apart=15.0, every=60.0))
    columns = ["site", "t", "r", "beta", "quality", "range_corrected"]
    both = pipeline.process(one.unionByName(two).select(columns)).layers
    for site, rows in (("a", one), ("b", two)):
        alone = pipeline.process(rows.select(columns)).layers
        told = lambda df: sorted((r.t, r.type, round(r.base, 3), None if r.top is None else round(r.top, 3)) for r in df.collect())  # noqa: B023, E731
        assert told(both.where(F.col("site") == site)) == told(alone) != []


def test_settings(tmp_path):
    s = settings.Settings().merged({"site": "x", "detect": {"scales": [10, 20], "unknown": 1}, "preprocess": {"speckle": 0.5}, "nothing": {}})
    assert s.site == "x" and s.detect.scales == (10, 20) and s.preprocess.speckle == 0.5 and s.track.gap == 900.0
    settings.save(s, str(tmp_path / "s.json"))
    assert settings.load(str(tmp_path / "s.json")) == s and settings.load(None) == settings.Settings()


def test_percentiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "SORTED", 50)
    monkeypatch.setattr(aggregates, "BINS", 8)
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=3000), "b": np.append(np.full(400, 7.0), rng.normal(size=300) * 1e6), "c": rng.normal(size=20), "d": np.full(500, 3.0), None: rng.integers(0, 4, 900).astype(float)}
    table = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)], "k string, v double")
    got = {r["k"]: r for r in aggregates.exact_percentiles(table, ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.95}).collect()}
    for k, x in groups.items():
        assert [got[k][n] for n in ("lo", "mid", "hi")] == pytest.approx(np.quantile(x, [0.01, 0.5, 0.95]).tolist(), rel=1e-12, abs=1e-12)
    assert aggregates.exact_percentiles(table.limit(0), ["k"], "v", {"p": 0.5}).isEmpty()


def test_frames_by_blocks_equal_one_frame(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t), None if rng.random() < 0.3 else float(t % 17)) for k in ("a", "b", None) for t in rng.permutation(101)] + [("few", t, float(t)) for t in range(4)] + [("none", t, None) for t in range(9)]
    table = spark.createDataFrame(rows, "k string, t long, v double")
    got = frames.running_mean(table, "k", ["t"], "v", 3, size=8, width=10).toPandas()
    assert len(got) == len(rows)
    for k in ("a", "few", "none"):
        one = got[got["k"] == k].sort_values("t")
        v, n = one["v"].to_numpy(), len(one)
        width = min(7, n)
        for i, mean in enumerate(one["mean"]):
            near = [v[min(max(j, 0), n - 1)] for j in range(i - width // 2, i - width // 2 + width)]
            near = [x for x in near if not np.isnan(x)]
            assert mean == pytest.approx(np.mean(near)) if near else np.isnan(mean)
    least = frames.running_min(table, "k", ["t"], "v", 2, size=8, width=10).where("k = 'a'").toPandas().sort_values("t")
    assert least["least"].tolist() == pytest.approx(least["v"].rolling(5, center=True, min_periods=1).min().tolist(), nan_ok=True)
