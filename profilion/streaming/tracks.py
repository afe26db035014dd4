"""The tracker on a stream of layers: what ``track.assigned`` gives on a whole table, as rows come in.

State is kept for each site and type: the tracks that may go on, and the detections that the watermark has not passed. Those wait, as
assignment needs their order, in stretches of time one gap long, each written in parts as rows come in; an event-time timer at the earliest
time of a stretch takes up what is due of it, so one stretch is in memory, and timers and calls to the state go by stretches, not rows.
Another timer, one gap after the last detection, ends the tracks and frees the state. Rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from profilion.operators.preprocess import SITE, TIME
from profilion.operators.track import SECOND, Active, Settings, track_name, tracking_height

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MILLI = 1000
#: Rows of one site and type that a task gathers before it writes them to the state.
HELD = 10_000


class Tracker(StatefulProcessor):
    def __init__(self, fields: list[str], waiting: StructType, s: Settings) -> None:
        self.fields, self.schema, self.s = fields, waiting, s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretch = max(int(self.s.gap * 1000), 1)
        self.parts = handle.getMapState("parts", "stretch long", "n long")
        self.waiting = handle.getMapState("waiting", "stretch long, part long", StructType([StructField("rows", ArrayType(self.schema))]))
        self.tracks = handle.getListState("tracks", "number long, t long, height double")
        self.session = handle.getValueState("session", "began long, last long, made long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        watermark, come, many, earliest = timerValues.getCurrentWatermarkInMs(), defaultdict(list), 0, {}
        for row in rows:
            if row[TIME] is None or row["type"] is None:
                continue  # tells the time only
            at = -(-row[TIME] // MILLI)
            if at > watermark:
                stretch = at // self.stretch
                come[stretch].append(tuple(row[f] for f in self.schema.names))
                earliest[stretch] = min(at, earliest.get(stretch, at))
                many += 1
                if many == HELD:
                    self.put_by(come)
                    come, many = defaultdict(list), 0
        self.put_by(come)
        for at in earliest.values():
            self.handle.registerTimer(at)
        return iter([])

    def put_by(self, come: dict[int, list[tuple]]) -> None:
        """Adds a part to each stretch; what it has is not read."""
        for stretch, rows in come.items():
            n = self.parts.getValue((stretch,))[0] if self.parts.containsKey((stretch,)) else 0
            self.waiting.updateValue((stretch, n), (rows,))
            self.parts.updateValue((stretch,), (n + 1,))

    def taken_out(self, stretch: int) -> list[dict]:
        """The rows of a stretch, which then holds none."""
        if not self.parts.containsKey((stretch,)):
            return []
        places = [(stretch, k) for k in range(self.parts.getValue((stretch,))[0])]
        rows = [dict(zip(self.schema.names, x, strict=True)) for place in places for x in self.waiting.getValue(place)[0]]
        for place in places:
            self.waiting.removeKey(place)
        self.parts.removeKey((stretch,))
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Timers go off in order of time, so earlier stretches have been taken up. One of a stretch that is empty by now does nothing."""
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        now = max(expiry, timerValues.getCurrentWatermarkInMs())  # nothing up to here can still come
        stretch = expiry // self.stretch
        held = self.taken_out(stretch)
        due = sorted((x for x in held if x[TIME] <= now * MILLI), key=lambda x: (x[TIME], *((v is not None, v or 0.0) for v in (x["base"], x["_height"]))))
        later = [x for x in held if x[TIME] > now * MILLI]
        active = self.restored()
        out, k = [], 0
        while k < len(due):
            n = next((j for j in range(k, len(due)) if due[j][TIME] != due[k][TIME]), len(due))
            heights = np.array([np.nan if x["_height"] is None else x["_height"] for x in due[k:n]], float)
            for x, number in zip(due[k:n], active.take(due[k][TIME], heights, self.s), strict=True):
                out.append(Row(**{f: x[f] for f in self.fields}, _began=active.began, _number=int(number)))
            k = n
        if later:
            self.put_by({stretch: [tuple(x[f] for f in self.schema.names) for x in later]})
            self.handle.registerTimer(min(-(-x[TIME] // MILLI) for x in later))
        if due:
            self.keep(active)
        elif active.last is not None and active.last + self.s.gap * SECOND < expiry * MILLI:  # what waits is later than this
            self.tracks.clear()
            self.session.clear()
        return iter(out)

    def restored(self) -> Active:
        if not self.session.exists():
            return Active([])
        began, last, made = self.session.get()
        return Active([list(x) for x in self.tracks.get()] if self.tracks.exists() else [], began, last, made)

    def keep(self, active: Active) -> None:
        self.session.update((active.began, active.last, active.made))
        self.tracks.put([(int(n), int(t), float(h)) for n, t, h in active.tracks])
        self.handle.registerTimer(int((active.last + self.s.gap * SECOND) // MILLI) + 1)

    def close(self) -> None:
        pass


def tracked(layers: DataFrame, delay: str = "0 seconds", s: Settings = Settings()) -> DataFrame:
    """A stream of layers (site, t, type, base, top, ...) with their tracks. delay: how much later than the latest row a row may come.

    Detections are given out once the watermark has passed them; a row whose type is NULL, of any site, does no more than move it."""
    layers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = layers.withColumn("_height", tracking_height()).withColumn("_at", F.timestamp_micros(TIME)).withWatermark("_at", delay)
    fields = layers.schema.fields
    waiting = StructType([*fields, rows.schema["_height"]])
    out = StructType([*fields, StructField("_began", LongType()), StructField("_number", LongType())])
    found = rows.groupBy(SITE, "type").transformWithState(Tracker([f.name for f in fields], waiting, s), out, "Append", "EventTime")
    return found.withColumn("track", track_name(F.col(SITE), F.col("type"), F.col("_began"), F.col("_number"))).drop("_began", "_number")
