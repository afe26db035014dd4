"""Detection on hand-made profiles: what is found, and what must not be."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilion.operators import detect, track

R = np.arange(770) * 10.0 + 5.0
NOISE = 2e-8


def profile(spark, *values, sigma=NOISE, n=1):
    rows = [("s", int(30e6 * k), R.tolist(), list(map(float, v)), [sigma] * len(R), list(map(float, v)), [sigma] * len(R), 0) for k, v in enumerate(values * n)]
    return spark.createDataFrame(rows, "site string, t long, r array<double>, beta array<double>, sigma array<double>, beta_smooth array<double>, sigma_smooth array<double>, quality long")


def slab(top, value, bottom=0.0, soft=40.0):
    return value * 0.5 * (1 - np.tanh((R - top) / soft)) * (0.5 * (1 + np.tanh((R - bottom) / soft)) if bottom else 1.0)


def found(spark, *values, **how):
    return [{x["type"]: x for x in r["layers"]} for r in detect.detect(profile(spark, *values, **how)).orderBy("t").collect()]


def test_a_layer_on_the_ground_is_the_mixing_layer(spark):
    one = found(spark, 2e-7 + slab(900, 4e-6))[0]
    assert set(one) == {"mixing_layer"} and abs(one["mixing_layer"]["top"] - 900) <= 30 and one["mixing_layer"]["base"] == 0.0
    assert 0.5 < one["mixing_layer"]["confidence"] <= 1


def test_a_contiguous_layer_above_is_residual_and_a_decoupled_one_haze(spark):
    residual, haze = found(spark, 2e-7 + slab(400, 6e-6) + slab(1500, 2e-6, 400), 2e-7 + slab(500, 5e-6) + slab(2800, 2e-6, 2100))
    assert set(residual) == {"mixing_layer", "residual_layer"} and residual["residual_layer"]["base"] == residual["mixing_layer"]["top"]
    assert abs(residual["residual_layer"]["top"] - 1500) <= 40
    assert set(haze) == {"mixing_layer", "haze"} and abs(haze["haze"]["base"] - 2100) <= 60 and abs(haze["haze"]["top"] - 2800) <= 60


def test_thin_layers_above_the_mixing_layer_are_not_claimed(spark):
    one = found(spark, 2e-7 + slab(800, 5e-6) + slab(1150, 2e-6, 800))[0]
    assert "residual_layer" not in one and "haze" not in one


def test_clear_air_and_noise_have_no_layers(spark):
    rng = np.random.default_rng(1)
    assert found(spark, np.full(770, 1e-7), rng.normal(0, NOISE, 770)) == [{}, {}]


def test_clouds(spark):
    air = 2e-7 + slab(900, 4e-6)
    cloud = np.where((R >= 1800) & (R < 1900), 1e-3, air)
    opaque = np.where(R >= 1900, 0.0, cloud)
    spike = air + np.where(np.arange(770) == 200, 1e-3, 0.0)
    open_, shut, single = found(spark, cloud, opaque, spike, sigma=1e-8)
    assert abs(open_["cloud"]["base"] - 1800) <= 20 and open_["cloud"]["top"] is not None and open_["cloud"]["confidence"] == 1.0
    assert shut["cloud"]["top"] is None and "cloud" not in single
    above = found(spark, np.where((R >= 1000) & (R < 1100), 1e-3, 2e-7 + slab(2000, 4e-6)))[0]
    assert all(x["type"] == "cloud" or x["top"] < 1000 for x in above.values())


def test_screened_profiles_have_no_layers(spark):
    rows = profile(spark, 2e-7 + slab(900, 4e-6)).withColumn("quality", F.lit(1).cast("long"))
    assert detect.detect(rows).first()["layers"] == []


def test_ceiling_reaches_as_far_as_smoothing(spark):
    air = 2e-7 + slab(900, 4e-6)
    rows = profile(spark, *[np.where((R >= 1200) & (R < 1300), 1e-3, air) if k == 10 else air for k in range(21)])
    got = detect.ceilings(detect.clouds(rows.withColumns({"box_rows": F.lit(5), "box_gates": F.lit(2)}))).orderBy("t").collect()
    assert [r["ceiling"] is not None for r in got] == [5 <= k <= 15 for k in range(21)]


def test_clusters_join_the_strongest_and_take_the_finest_height(spark):
    rows = spark.sql("""SELECT array(named_struct('strength', 9D, 'sign', 1, 'height', 1000D, 'amplitude', 0.5D, 'scale', 240D, 'refined', 990D),
        named_struct('strength', 5D, 'sign', 1, 'height', 1040D, 'amplitude', 0.7D, 'scale', 60D, 'refined', 1030D),
        named_struct('strength', 4D, 'sign', -1, 'height', 1000D, 'amplitude', 0.2D, 'scale', 60D, 'refined', 1000D),
        named_struct('strength', 3D, 'sign', 1, 'height', 2000D, 'amplitude', 0.2D, 'scale', 120D, 'refined', 2010D)) AS c""")
    got = rows.select(detect.clustered("c").alias("e")).first()["e"]
    assert [(e["sign"], e["height"], e["strength"], e["amplitude"], e["best_scale"], sorted(e["scales"])) for e in got] == [(-1, 1000.0, 4.0, 0.2, 60.0, [60.0]), (1, 1030.0, 9.0, 0.7, 60.0, [60.0, 240.0]), (1, 2010.0, 3.0, 0.2, 120.0, [120.0])]


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5, 2)
    cost, allowed = rng.integers(0, 50, (n, m)).astype(float), rng.random((n, m)) < 0.7
    got = track.assign(cost, allowed)
    best = (0, 0.0)
    for k in range(1, min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.permutations(range(m), k):
                if all(allowed[r, c] for r, c in zip(rows, columns)):
                    best = min(best, (-k, sum(cost[r, c] for r, c in zip(rows, columns))))
    assert (-len(got), sum(cost[r, c] for r, c in got)) == best and all(allowed[p] for p in got)


def layers_of(spark, rows):
    return spark.createDataFrame([("s", int(t * 1e6), kind, float(base), None if top is None else float(top), 0.8, "{}") for t, kind, base, top in rows], "site string, t long, type string, base double, top double, confidence double, meta string")


def times_of(spark, n, step=30):
    return spark.createDataFrame([("s", int(k * step * 1e6), k == 7) for k in range(n)], "site string, t long, screened boolean")


def test_two_tracks_cross_gaps_and_flicker_goes(spark):
    rows = [(30 * k, "haze", 2000 + k, 2500) for k in range(20) if k not in (5, 6, 7)] + [(30 * k, "haze", 3000 - k, 3300) for k in range(20)] + [(30 * 4, "haze", 1000, 1200)]
    found = track.track(layers_of(spark, rows), times_of(spark, 20)).toPandas()
    assert found["track"].nunique() == 2 and len(found) == 40 and found["interpolated"].sum() == 3
    filled = found[found["interpolated"]].sort_values("t")
    assert np.allclose(filled["base"], [2005, 2006, 2007], atol=1.01) and (filled["confidence"] == 0.4).all()
    strict = track.track(layers_of(spark, rows), times_of(spark, 20), track.Settings(fill_screened=False)).toPandas()
    assert strict["interpolated"].sum() == 2


def test_long_gaps_end_tracks_and_spikes_are_smoothed(spark):
    rows = [(30 * k, "mixing_layer", 0, 500 + (150 if k == 3 else 0)) for k in range(8)] + [(1980 + 30 * k, "mixing_layer", 0, 520) for k in range(8)]
    found = track.track(layers_of(spark, rows), times_of(spark, 80)).toPandas().sort_values("t")
    assert found["track"].nunique() == 2 and not found["interpolated"].any() and found["top"].max() <= 520


def test_one_mixing_layer_a_profile_and_the_residual_layer_rests_on_it(spark):
    rows = [(30 * k, kind, base, top) for k in range(6) for kind, base, top in (("mixing_layer", 0, 500), ("mixing_layer", 0, 1500), ("residual_layer", 510, 1400))]
    found = track.track(layers_of(spark, rows), times_of(spark, 6)).toPandas()
    assert (found.groupby(["t", "type"]).size() == 1).all()
    both = found.pivot(index="t", columns="type", values=["base", "top"])
    assert (both["base", "residual_layer"] == both["top", "mixing_layer"]).all()


def test_no_layers(spark):
    none = layers_of(spark, [(0, "haze", 1, 2)]).limit(0)
    assert track.track(none, times_of(spark, 3)).isEmpty()
    assert detect.detect(profile(spark, np.full(770, 1e-7)).limit(0)).isEmpty()
