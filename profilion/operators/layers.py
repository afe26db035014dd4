"""Operators on tables of layers (site, t, type, base, top, confidence, track, interpolated, meta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = "site string, t long, type string, base double, top double, confidence double, track string, interpolated boolean, meta string"


def to_json(layers: DataFrame) -> DataFrame:
    """Each layer as one JSON text (column record)."""
    return layers.select(F.to_json(F.struct(*[F.col(c) for c in layers.columns])).alias("record"))


def from_json(records: DataFrame, schema: str = RECORD) -> DataFrame:
    return records.select(F.from_json("record", schema).alias("x")).select("x.*")


def selected(layers: DataFrame, lo: Column, hi: Column, types: list[str] | None = None, least: float = 0.0, interpolated: bool = True) -> DataFrame:
    """Layers from lo to hi of some types and at least so sure, with or without interpolated ones, by time, base and type."""
    rows = layers.where(F.col("t").between(lo, hi) & (F.col("confidence") >= least))
    rows = rows.where(F.col("type").isin(types)) if types else rows
    return (rows if interpolated else rows.where(~F.col("interpolated"))).orderBy("t", "base", "type")


def surest(layers: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The surest layer of each group; ties go to the least of the tie columns."""
    order = F.struct((-F.col("confidence")).alias("_c"), *ties)
    return layers.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in layers.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")


def lowest(layers: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The lowest layer of each group."""
    order = F.struct("base", *ties)
    return layers.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in layers.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")


def with_base_below(tops: DataFrame, bases: DataFrame, keys: list[str], above: float, clearance: float, there: bool = True) -> DataFrame:
    """tops (keys, height) of profiles that have (or have not) a base higher than ``above`` and at least so far below them.

    The lowest base above the limit decides, so bases come down to one row for each profile before the join."""
    low = bases.where(F.col("height") > above).groupBy(*keys).agg(F.min("height").alias("_low"))
    rows = tops.join(low, keys, "left")
    has = F.coalesce(F.col("_low") < F.col("height") - clearance, F.lit(False))
    return rows.where(has if there else ~has).drop("_low")


def nearest_peak(edges: DataFrame, fields: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """edges (keys, height, ...) with peak, the height within reach (below it not included at the upper end) where their profile's
    field (keys, at, v) is largest; the lower one of equals."""
    near = edges.join(fields, keys).where((F.col("at") >= F.col("height") - reach) & (F.col("at") < F.col("height") + reach) & F.col("v").isNotNull())
    best = near.groupBy(*keys, "height").agg(F.min_by("at", F.struct((-F.col("v")).alias("v"), "at")).alias("peak"))
    return edges.join(best, [*keys, "height"], "left")


def holds_types(layers: DataFrame, keys: list[str], types: list[str]) -> DataFrame:
    """Groups that have layers of all these types."""
    return layers.groupBy(*keys).agg(F.collect_set(F.when(F.col("type").isin(types), F.col("type"))).alias("_t")).where(F.size("_t") == len(set(types))).drop("_t")  # at most the types


def stacked(layers: DataFrame, keys: list[str], under: str = "mixing_layer", over: str = "residual_layer") -> DataFrame:
    """The upper layer's base becomes the lower one's top; a top is not below its base."""
    top = F.max(F.when(F.col("type") == under, F.col("top"))).over(Window.partitionBy(*keys))
    rows = layers.withColumn("_under", F.when(F.col("type") == over, top)).withColumn("base", F.coalesce("_under", "base"))
    return rows.withColumn("top", F.when(F.col("_under").isNotNull() & (F.col("top") < F.col("base")), F.col("base")).otherwise(F.col("top"))).drop("_under")


# -- meta as a value whose shape may differ by layer type


def typed(layers: DataFrame, column: str = "meta") -> DataFrame:
    """Layers with their meta parsed to a VARIANT, once, when they are made or read; what is no JSON becomes NULL."""
    return layers.withColumn(column, F.try_parse_json(column))


def meta_value(path: str, kind: str, column: str = "meta") -> Column:
    """What a layer's VARIANT meta has at a path such as $.contrast; NULL where its type has no such thing, or another kind of it."""
    return F.try_variant_get(column, path, kind)


def meta_shapes(layers: DataFrame, column: str = "meta") -> DataFrame:
    """(type, shape): the schema that the metas of each layer type have together."""
    return layers.groupBy("type").agg(F.schema_of_variant_agg(column).alias("shape"))
