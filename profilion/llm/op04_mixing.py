"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between knots. Its integral says how much
of the source's target is due by any time; inverting it at a document's cumulative words gives the time at
which training needs the document: its position. Documents are then range-sorted by position.

Targets share ``budget`` times all words by weight, and none passes ``cap`` times its source's size: what
is above is shared anew by weight among the rest (the level at which this ends has a closed form over the
sources in order of cap per weight). A source is played in a hashed order, which reruns repeat, in whole
passes and a last partial one; the document at its end is taken in part, so that taken words meet targets.

The cumulative words of a source are sums over ranges of the hashed order, about RANGE_ROWS rows each, and then
within one, so that a source holding a third of all rows is dealt out like the others.

Cases: a null text has size 0 and is played with no words; a null source is a source of its own, the last;
sources without words have target 0; an empty table gives none; repeated rows are played each on their own,
in any order among themselves; extra columns are carried, whatever their names (those named as a result are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilion.llm.cluster import settle

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 20_000
#: Weights of the sources in order, and how each one's weight moves: (start, end) as multiples, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
KEYS = ("mix_source", "mix_range")
RESULTS = ("source_size", "target", "plays")


def words(text: str = "text"):
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, source: str, size: str, order: list[str]) -> DataFrame:
    """A source key that is never null (null sorts last), the hashed order and its range, and the document as a struct."""
    bits = max(0, math.ceil(math.log2(max(docs.count(), 1) / RANGE_ROWS))) 
    key = F.when(F.col(source).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source)))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), key.alias("mix_source"), F.coalesce(size, F.lit(0)).cast("long").alias("mix_size"), F.xxhash64(*order, F.lit(4)).alias("mix_order"))
    return rows.withColumn("mix_range", F.shiftright("mix_order", 64 - bits) if bits else F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(mix_source, source_size, place, weight, target), from one row per source (mix_source, source_size)."""
    ordered, all_rows = Window.orderBy("mix_source"), Window.partitionBy()
    by_room = Window.orderBy("room", "mix_source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(ordered) - 1).withColumn("weight", w)
    rows = rows.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("room", F.col("most") / F.col("weight"))
    rows = rows.withColumn("before", F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(budget) - F.col("before")) / F.col("open"))
    level = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.col("room"))).over(all_rows)
    return rows.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("most")), F.col("most"))).select("mix_source", "source_size", "place", "weight", "target")


def default_schedule(sources: DataFrame, ramps=RAMPS) -> DataFrame:
    """sources with schedule: pieces (t0, t1, w0, w1) of weight over time."""
    ramp = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ramps]), (F.col("place") % len(ramps) + 1).cast("int"))
    return sources.withColumn("schedule", F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), (ramp["a"] * F.col("weight")).alias("w0"), (ramp["b"] * F.col("weight")).alias("w1"))))


def due_time(share, schedule):
    """The time by which a schedule's integral reaches ``share`` (0..1) of its whole."""
    area = lambda p: (p["w0"] + p["w1"]) / 2 * (p["t1"] - p["t0"])
    total = F.aggregate(schedule, F.lit(0.0), lambda s, p: s + area(p))
    start = F.struct((share * total).alias("left"), F.lit(None).cast("double").alias("time"))

    def step(s, p):
        slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
        root = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + slope * s["left"] * 2.0, F.lit(0.0)))
        here = p["t0"] + F.when(s["left"] > 0, s["left"] * 2.0 / root).otherwise(0.0)
        inside = s["time"].isNull() & (s["left"] <= area(p))
        return F.struct((s["left"] - area(p)).alias("left"), F.when(inside, here).otherwise(s["time"]).alias("time"))

    return F.coalesce(F.aggregate(schedule, start, step)["time"], F.lit(1.0))


def mix(docs: DataFrame, source: str = "source", size: str = "size", order: tuple[str, ...] = ("doc_id",), schedule=default_schedule, **how) -> DataFrame:
    """docs, row by row, with source_size, target and plays: an array of (words, position), one for each time
    that the mix plays the document."""
    kept = [c for c in docs.columns if c not in RESULTS]
    rows = keyed(docs.select(*[f"`{c}`" for c in kept]), source, size, list(order))
    ranges = rows.groupBy(*KEYS).agg(F.sum("mix_size").alias("range_size"))
    sources = schedule(targets(ranges.groupBy("mix_source").agg(F.sum("range_size").alias("source_size")), **how))
    before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    ranges = ranges.join(sources, "mix_source").drop("range_size", "place", "weight")
    inside = Window.partitionBy(*KEYS).orderBy("mix_order", *[f"doc.{c}" for c in order], "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges.hint("merge"), list(KEYS)).withColumn("mix_start", F.col("range_start") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    whole = F.round(F.col("target")).cast("long")

    def play(k):
        at = k * F.col("source_size") + F.col("mix_start")
        took = F.greatest(F.least(whole - at, F.col("mix_size")), F.lit(0)).cast("long")
        return F.struct(took.alias("words"), F.when(F.col("target") > 0, due_time(F.least(at / F.col("target"), F.lit(1.0)), F.col("schedule"))).otherwise(1.0).alias("position"))

    passes = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(0)
    plays = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1), play), lambda p: p["words"] > 0)
    rows = rows.select("doc", F.struct("source_size", "target", plays.alias("plays")).alias("mixed"))
    return rows.select("doc.*", "mixed.*")


def training_order(mixed: DataFrame, size: str = "size") -> DataFrame:
    """One row for each play of a document, sorted by position: the partitions follow each other in time.

    Documents stay whole: a last play in part counts where it takes at least half of the document. A document without
    words adds none to any source; it is kept once, at the end."""
    none = F.array(F.struct(F.lit(0).cast("long").alias("words"), F.lit(1.0).alias("position")))
    one = mixed.withColumn("plays", F.when(F.coalesce(size, F.lit(0)) == 0, none).otherwise(F.col("plays")))
    one = one.withColumn("plays", F.explode("plays")).where(F.col("plays.words") * 2 >= F.coalesce(size, F.lit(0)))
    return one.withColumn("position", F.col("plays.position")).drop("plays").orderBy("position", "doc_id")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Documents in the order in which training first needs them; position is null where the mix takes none."""
    docs = settle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words().alias("size")))
    mixed = mix(docs).withColumn("taken", F.aggregate("plays", F.lit(0).cast("long"), lambda s, p: s + p["words"]))
    mixed = mixed.withColumn("position", F.try_element_at("plays", F.lit(1))["position"])
    return mixed.orderBy(F.asc_nulls_last("position"), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")
