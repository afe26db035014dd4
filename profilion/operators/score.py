"""Layers held against what is true: detection, false alarms and errors of each feature, and the screens' recall and precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilion.operators.aggregates import exact_percentiles

#: Feature, its layer, which of the profile's (lowest or surest), which height, truth and visibility columns, tolerance in metres and least detection rate.
FEATURES = (
    ("cloud_base", "cloud", "lowest", "base", "cloud_base", "cloud_visible", 50.0, 0.90),
    ("mixing_top", "mixing_layer", "surest", "top", "mixing_top", "mixing_visible", 150.0, 0.85),
    ("residual_top", "residual_layer", "surest", "top", "residual_top", "residual_visible", 150.0, 0.75),
    ("haze_base", "haze", "surest", "base", "haze_base", "haze_visible", 150.0, 0.80),
    ("haze_top", "haze", "surest", "top", "haze_top", "haze_visible", 200.0, 0.80),
)
#: Largest bias in metres and false alarm rate, least share within the tolerance, recall and precision.
MOST_BIAS, MOST_FALSE, LEAST_WITHIN, LEAST_RECALL, LEAST_PRECISION = 75.0, 0.15, 0.85, 0.95, 0.80


def heights(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., feature, found): the height that each profile's layers give for each feature they have."""
    out = []
    for feature, kind, which, height, *_ in FEATURES:
        order = F.struct(F.col("base").alias("a"), (-F.col("confidence")).alias("b")) if which == "lowest" else F.struct((-F.col("confidence")).alias("a"), F.col("base").alias("b"))
        out.append(layers.where(F.col("type") == kind).groupBy(*keys).agg(F.min_by(height, order).alias("found")).select(*keys, F.lit(feature).alias("feature"), "found"))
    return reduce(DataFrame.unionByName, out)


def feature_scores(layers: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each feature. Profiles count where truth has the feature and it can be seen; false alarms where truth has
    none and the profile is not screened. Rates without a profile are NULL, the false alarm rate then is 0."""
    told = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(t).cast("double").alias("wanted"), F.col(v).alias("visible"), F.lit(tol).alias("tolerance")) for f, _, _, _, t, v, tol, _ in FEATURES])
    rows = truth.select(*keys, "screened", F.explode(told).alias("x")).select(*keys, "screened", "x.*")
    rows = rows.join(heights(layers, keys), [*keys, "feature"], "left")
    seen = F.coalesce("visible", F.lit(False)) & F.col("wanted").isNotNull()
    absent = ~seen & ~F.coalesce("screened", F.lit(False)) & F.col("wanted").isNull()
    rows = rows.withColumn("e", F.when(seen, F.col("found") - F.col("wanted"))).withColumn("apart", F.abs("e")).withColumn("seen", seen).withColumn("absent", absent)
    counts = rows.groupBy("feature", "tolerance").agg(F.count_if("seen").alias("observable"), F.count("e").alias("matched"), F.count_if("absent").alias("absent"), F.count_if(F.col("absent") & F.col("found").isNotNull()).alias("false_alarms"), F.avg("e").alias("bias"), F.avg("apart").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg((F.col("apart") <= F.col("tolerance")).cast("double")).alias("within"))
    counts = counts.withColumn("detection_rate", F.try_divide("matched", "observable")).withColumn("false_rate", F.coalesce(F.try_divide("false_alarms", "absent"), F.lit(0.0)))
    return counts.join(exact_percentiles(rows, ["feature"], "apart", {"p95": 0.95}), "feature", "left")


def screen_scores(profiles: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and precision of the fog and rain flags; 1 where there is nothing to find or nothing was flagged."""
    rows = truth.select(*keys, "fog", "rain").join(profiles.select(*keys, "quality"), keys)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("screen"), F.col(n).alias("wanted"), (F.col("quality").bitwiseAND(b) != 0).alias("flagged")) for n, b in (("fog", 2), ("rain", 1))])).alias("x")
    rows = rows.select(each).select("x.*")
    found = rows.groupBy("screen").agg(F.count_if("wanted").alias("true_n"), F.count_if("flagged").alias("flagged_n"), F.count_if(F.col("wanted") & F.col("flagged")).alias("hits"))
    return found.withColumn("recall", F.coalesce(F.try_divide("hits", "true_n"), F.lit(1.0))).withColumn("precision", F.coalesce(F.try_divide("hits", "flagged_n"), F.lit(1.0)))


def failures(features: DataFrame, screens: DataFrame, least_rates: dict[str, float] | None = None) -> list[str]:
    """What misses its limit, in words; an empty list if all is well. The tables have five and two rows."""
    rates, out = {f[0]: f[-1] for f in FEATURES} | (least_rates or {}), []
    for r in features.orderBy("feature").collect():
        if not r["observable"]:
            out.append(f"{r['feature']}: nothing to see")
            continue
        for bad, text in (
            (r["detection_rate"] < rates[r["feature"]], f"detection rate {r['detection_rate']:.1%} below {rates[r['feature']]:.0%}"),
            (r["bias"] is None or abs(r["bias"]) > MOST_BIAS, f"bias {r['bias']} beyond {MOST_BIAS:.0f} m"),
            (r["within"] is None or r["within"] < LEAST_WITHIN, f"{r['within']} within {r['tolerance']:.0f} m, below {LEAST_WITHIN:.0%}"),
            (r["false_rate"] > MOST_FALSE, f"false alarms {r['false_rate']:.1%} above {MOST_FALSE:.0%}"),
        ):
            out += [f"{r['feature']}: {text}"] if bad else []
    for r in screens.orderBy("screen").collect():
        out += [f"{r['screen']}: {k} {r[k]:.1%} below {least:.0%}" for k, least in (("recall", LEAST_RECALL), ("precision", LEAST_PRECISION)) if r[k] < least]
    return out


def report(features: DataFrame, screens: DataFrame) -> str:
    """Both tables as text."""
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    out = []
    for table, first in ((features, "feature"), (screens, "screen")):
        rows = [table.columns, *([show(v) for v in r] for r in table.orderBy(first).collect())]
        widths = [max(len(r[k]) for r in rows) for k in range(len(table.columns))]
        out += ["  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in rows]
    return "\n".join(out)
