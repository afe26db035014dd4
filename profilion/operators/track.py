"""Layers through time: each detection joins a track by optimal assignment, tracks are smoothed, and their gaps filled.

Rows are layers (site, t, type, base, top, confidence, meta). A gap longer than the limit ends all tracks of a site and type, so
each session between such gaps is assigned by itself, in order of time, by a task that holds only what is active. All else
are windows over tracks and profiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from profilion.operators import frames, layers, temporal
from profilion.operators.preprocess import SITE, TIME

SECOND = 1_000_000


@dataclass(frozen=True)
class Settings:
    """The defaults, in metres, metres per minute, seconds and profiles."""

    jump: float = 250.0
    jump_per_minute: float = 120.0
    gap: float = 900.0
    least: int = 5
    smooth_half: int = 2
    fill: bool = True
    #: Fill also where the profiles between are screened.
    fill_screened: bool = True


def tracking_height() -> Column:
    """The height that a layer is followed by: the base of clouds and haze, else the top."""
    return F.when(F.col("type").isin("cloud", "haze"), F.col("base")).otherwise(F.coalesce("top", "base"))


def assign(cost: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of an assignment with as many allowed pairs as can be and, of those, the least total cost.

    Rows enter one at a time along a shortest augmenting path, with prices that keep all reduced costs at 0 or above."""
    flip = cost.shape[0] > cost.shape[1]
    value = np.where(allowed, cost, np.max(cost, initial=0.0) + 1e6)
    value = value.T if flip else value
    rows, columns = value.shape
    row_price, column_price, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for start in range(rows):
        reach, via, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, column, paid = start, -1, 0.0
        while True:
            step = paid + value[row] - row_price[row] - column_price
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], column
            column = int(np.argmin(np.where(done, np.inf, reach)))
            paid = reach[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[start] += paid
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                row_price[owner[c]] += paid - reach[c]
            column_price[c] -= paid - reach[c]
        while column >= 0:  # the path back hands each row on to the next column
            before = via[column]
            owner[column] = start if before < 0 else owner[before]
            column = before
    pairs = [(int(c), int(r)) if flip else (int(r), int(c)) for c, r in enumerate(owner) if r >= 0]
    return sorted(p for p in pairs if allowed[p])


@dataclass
class Active:
    """The tracks of one site and type that may go on: [number, last time, last height] each, when their session began, its last time,
    and how many tracks it has had."""

    tracks: list[list]
    began: int | None = None
    last: int | None = None
    made: int = 0

    def go_on(self, t: int, s: Settings) -> None:
        if self.last is None or t - self.last > s.gap * SECOND:
            self.tracks, self.began, self.made = [], t, 0
        self.last = t
        self.tracks = [a for a in self.tracks if t - a[1] <= s.gap * SECOND]

    def take_one(self, t: int, height: float, s: Settings) -> int:
        """The track of the only detection of a time: the nearest within reach, the first of those equally near, as ``take`` has it."""
        self.go_on(t, s)
        nearest, least = None, math.inf
        for a in self.tracks:
            apart = abs(height - a[2])
            if apart < least and apart <= s.jump + s.jump_per_minute * ((t - a[1]) / SECOND / 60):
                nearest, least = a, apart
        if nearest is None:
            nearest = [self.made, t, height]
            self.tracks.append(nearest)
            self.made += 1
        nearest[1:] = [t, height]
        return nearest[0]

    def take(self, t: int, heights: np.ndarray, s: Settings) -> np.ndarray:
        """The tracks of the detections of one time, later than all before: by optimal assignment to the tracks within reach, or new
        ones. A gap longer than the limit ends all tracks and opens a session."""
        if len(heights) == 1:
            return np.array([self.take_one(t, float(heights[0]), s)])
        self.go_on(t, s)
        found = np.full(len(heights), -1)
        if self.tracks:
            reach = s.jump + s.jump_per_minute * np.array([(t - a[1]) / SECOND / 60 for a in self.tracks])
            apart = np.abs(heights[:, None] - np.array([a[2] for a in self.tracks]))
            for d, k in assign(apart, apart <= reach):
                self.tracks[k][1:] = [t, heights[d]]
                found[d] = self.tracks[k][0]
        for d in np.flatnonzero(found < 0):
            self.tracks.append([self.made, t, heights[d]])
            found[d], self.made = self.made, self.made + 1
        return found


def track_name(site: Column, type_: Column, began: Column, number: Column) -> Column:
    """Unique with site and type, and in itself."""
    return F.concat_ws(":", site.cast("string"), type_, began.cast("string"), number.cast("string"))


def assigned(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds track to layers found."""
    at = F.struct(SITE, "type")
    rows = temporal.sessions(found.withColumn("_key", F.to_json(at)), "_key", TIME, "base", int(s.gap * SECOND)).withColumn("_height", tracking_height())
    rows = rows.repartition("_key", "session").sortWithinPartitions("_key", "session", TIME, "base", "_height")
    schema = StructType([*rows.schema.fields, StructField("_began", LongType()), StructField("_track", LongType())])

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, active = None, None, Active([])

        def taken(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            """A frame of whole times with its tracks. It is given out as one: a frame for each time would cost more than all else."""
            nonlocal now, active
            keys, sessions, times, heights = part["_key"].to_numpy(), part["session"].to_numpy(), part[TIME].tolist(), part["_height"].to_numpy(float)
            began, tracks = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
                key = (keys[a], sessions[a])
                if key != now:
                    now, active = key, Active([])
                tracks[a:b] = active.take_one(int(times[a]), float(heights[a]), s) if b - a == 1 else active.take(int(times[a]), heights[a:b], s)
                began[a:b] = active.began
            return part.assign(_began=began, _track=tracks)

        for table in tables:
            table = table if held is None else pd.concat([held, table], ignore_index=True)
            if not len(table):
                continue
            at = [table[c].to_numpy() for c in ("_key", "session", TIME)]
            starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in at])]))
            held = table.iloc[starts[-1] :]  # the last time may go on
            if starts[-1]:
                yield taken(table.iloc[: starts[-1]], starts[:-1])
        if held is not None and len(held):
            yield taken(held, np.array([0]))

    named = track_name(F.col(SITE), F.col("type"), F.col("_began"), F.col("_track"))
    return rows.mapInPandas(run, schema).withColumn("track", named).drop("_key", "session", "_height", "_began", "_track")


def smoothed(tracked: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Tracks with enough detections, their heights as running medians; a top is not below its base."""
    rows = temporal.supported(tracked, ["track"], s.least).drop("support").withColumn("_at", tracking_height()).withColumn("_top", F.col("top"))
    for c in ("_at", "top", "base"):
        rows = frames.padded_median(rows, ["track"], [TIME, "base"], c, s.smooth_half, f"_{c.strip('_')}_s")
    by_base = F.col("type").isin("cloud", "haze")
    base = F.when(by_base, F.col("_at_s")).otherwise(F.col("_base_s"))
    top = F.when(by_base, F.when(F.col("_top").isNotNull(), F.col("_top_s"))).otherwise(F.col("_at_s"))
    return rows.withColumn("base", base).withColumn("top", F.when(top < base, base).otherwise(top)).drop("_at", "_top", "_at_s", "_top_s", "_base_s")


def filled(smooth: DataFrame, times: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Layers with those of the profiles between a track's members, in a straight line, marked interpolated and half as sure.

    times: (site, t) of all profiles, and screened, if gaps of screened profiles are to stay."""
    places = frames.numbered(times, [SITE], TIME).drop("n")
    rows = smooth.join(places.select(SITE, TIME, "i"), [SITE, TIME]).withColumn("interpolated", F.lit(False))
    w = Window.partitionBy("track").orderBy("i")
    after = F.lead(F.struct("i", TIME, "base", "top", "confidence")).over(w)
    gaps = rows.withColumn("z", after).where((F.col("z.i") - F.col("i") > 1) & (F.col(f"z.{TIME}") - F.col(TIME) <= int(s.gap * SECOND)))
    gaps = gaps.withColumn("k", F.explode(F.sequence(F.col("i") + 1, F.col("z.i") - 1)))
    share = (F.col("k") - F.col("i")) / (F.col("z.i") - F.col("i"))
    line = lambda c: (F.col(c) + (F.col(f"z.{c}") - F.col(c)) * share).alias(c)
    between = F.to_json(F.struct(F.array("i", "z.i").alias("filled_between")))
    made = gaps.select(SITE, F.col("k").alias("i"), "type", line("base"), line("top"), (F.least("confidence", "z.confidence") * 0.5).alias("confidence"), between.alias("meta"), "track", F.lit(True).alias("interpolated"))
    made = made.join(places, [SITE, "i"])
    if not s.fill_screened:
        made = made.where(~F.col("screened"))
    return rows.drop("i").unionByName(made.select(*[c for c in rows.columns if c != "i"]))


def deduplicated(found: DataFrame) -> DataFrame:
    """At most one mixing and one residual layer in a profile: measured before interpolated, then the surer, then the lower."""
    once = F.col("type").isin("mixing_layer", "residual_layer")
    order = [F.col("interpolated"), F.desc("confidence"), "base", "track"]
    kept = temporal.first_of(found.where(once), [SITE, TIME, "type"], order)
    return kept.unionByName(found.where(~once))


def reconciled(found: DataFrame) -> DataFrame:
    """The residual layer rests on the mixing layer of its profile."""
    return layers.stacked(found, [SITE, TIME])


def track(found: DataFrame, times: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All of the above: (site, t, type, base, top, confidence, meta, track, interpolated)."""
    rows = smoothed(assigned(found, s), s)
    rows = filled(rows, times, s) if s.fill else rows.withColumn("interpolated", F.lit(False))
    return reconciled(deduplicated(rows))
