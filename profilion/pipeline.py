"""From files to stored layers: read, preprocess, detect, track, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.operators import detect, preprocess, track
from profilion.operators.preprocess import SITE, TIME
from profilion.session import settle
from profilion.settings import Settings
from profilion.sources import formats
from profilion.sources.store import Store

KEPT = ("site", "t", "r", "beta", "beta_smooth", "sigma_smooth", "quality", "clouds")


@dataclass(frozen=True)
class Processed:
    """Detected profiles, and the layers of all of them, tracked."""

    profiles: DataFrame
    layers: DataFrame


def process(profiles: DataFrame, s: Settings = Settings()) -> Processed:
    """Profiles (t, r, beta, quality, and maybe site and range_corrected) through all steps. Of rows of one site and time one
    stays, that of least quality bits."""
    rows = profiles if SITE in profiles.columns else profiles.withColumn(SITE, F.lit(s.site))
    first = F.struct(F.coalesce("quality", F.lit(0)), F.xxhash64("beta"))
    rows = rows.groupBy(SITE, TIME).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (SITE, TIME)]), first).alias("x")).select(SITE, TIME, "x.*")
    found = settle(detect.detect(settle(preprocess.preprocess(rows, s.preprocess)), s.detect, s.preprocess))
    times = found.select(SITE, TIME, (F.col("quality").bitwiseAND(167) != 0).alias("screened"))
    return Processed(found, settle(track.track(detect.long_layers(found), times, s.track)))


def ingest(spark: SparkSession, inputs: str | list[str], s: Settings = Settings(), form: str | None = None, **options) -> dict:
    """Reads files, processes them, and replaces what the store has of their span. Returns counts, by type for layers."""
    rows = formats.same_grid(settle(formats.read(spark, inputs, form, **options)))
    done = process(rows, s)
    store = Store(spark, s.storage.path, s.storage.bucket_hours, s.storage.retention_hours)
    first = done.profiles.select(preprocess.spacing("r").alias("dz"), F.size("r").alias("gates"), F.array_max("r").alias("top")).first()
    facts = {"site": s.site, "instrument": s.instrument, "spacing": first["dz"], "gates": first["gates"], "highest": first["top"], "lowest_usable": preprocess.lowest_usable_height(s.preprocess), "settings": s.to_dict()} if first else {}
    told = store.write(done.profiles.select(*[c for c in KEPT if c in done.profiles.columns]), done.layers, **facts)
    return told | {"types": {r["type"]: r["count"] for r in done.layers.groupBy("type").count().collect()}}
