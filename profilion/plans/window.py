"""A window of the store as a client draws it: bounded in rows and gates, a byte for each cell, and its layers by type."""

from __future__ import annotations

import json
import math
import struct
from base64 import b64encode
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import aggregates, facts, frames
from profilion.operators.aggregates import exact_percentiles
from profilion.session import settle
from profilion.sources.store import HOUR, Store, compatible

MAGIC, VERSION = b"PRFW", 1


@dataclass(frozen=True)
class Request:
    """What a client asks for; limits are fixed values."""

    #: The hours up to the latest profile; None asks for all that is stored. Cells are bounded by rows and gates in either case.
    hours: float | None = 24.0
    max_rows: int = 1200
    max_gates: int = 400
    max_height: float | None = None
    vmin: float = fn.VMIN
    vmax: float = fn.VMAX
    layers: bool = True
    least: float = 0.0
    #: The site that is asked for; it may be left out where the store holds one.
    site: str | int | None = None
    #: Points of layers that one answer may hold.
    max_points: int = 500_000

    def __post_init__(self) -> None:
        for name, good in (("hours", self.hours is None or 0 < self.hours <= 720), ("max_rows", 16 <= self.max_rows <= 20_000), ("max_gates", 16 <= self.max_gates <= 5_000), ("max_height", self.max_height is None or self.max_height > 0), ("least", 0 <= self.least <= 1), ("vmax", self.vmax > self.vmin)):
            if not good:
                raise ValueError(f"{name} is out of its range: {getattr(self, name)}")


def factors(rows: int, gates: int, max_rows: int, max_gates: int) -> tuple[int, int]:
    """How many rows and gates make a cell."""
    return max(1, math.ceil(rows / max_rows)), max(1, math.ceil(gates / max_gates))


def cell_mean(values: Column, factor: int | Column) -> Column:
    """Means of so many neighbouring values each, of those that are there."""
    factor = F.lit(factor) if isinstance(factor, int) else factor
    at = F.sequence(F.lit(0), F.size(values) - 1, factor)
    return F.transform(at, lambda k: fn.array_mean(F.slice(values, k + 1, factor)))


def downsampled(profiles: DataFrame, row_factor: int | str, gate_factor: int | str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (t, beta, r, quality) of row_factor profiles each, counted from the first of their keys: means over time, then over gates, so
    that missing cells weigh as they do there; quality bits of all are kept. Factors may be columns, the same for all rows of a key."""
    column = lambda f: F.lit(f) if isinstance(f, int) else F.col(f)
    rows = frames.numbered(profiles.withColumn("_gates", column(gate_factor)), keys, "t").withColumn("row", F.floor(F.col("i") / column(row_factor)))
    gates = rows.select(*keys, "row", F.posexplode("beta").alias("gate", "v")).groupBy(*keys, "row", "gate").agg(F.avg("v").alias("v"))
    beta = gates.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("gate", "v"))), lambda x: x["v"]).alias("beta"))  # a profile's gates
    head = rows.groupBy(*keys, "row").agg(F.avg("t").alias("t"), F.bit_or("quality").alias("quality"), F.min_by("r", "t").alias("r"), F.count("*").alias("n"), F.max("_gates").alias("_gates"))
    out = head.join(beta, [*keys, "row"], "left")
    return out.withColumn("beta", cell_mean(F.col("beta"), F.col("_gates"))).withColumn("r", cell_mean(F.col("r"), F.col("_gates"))).drop("_gates")


def windows_of_sites(store: Store, request: Request = Request()) -> DataFrame:
    """Cells (site, row, t, quality, r, beta, codes) of every site's window, each of the hours up to that site's latest profile, on the grid of
    its first one, and with factors of its own. Nothing is collected: sites are handled side by side."""
    rows = store.window(max_height=request.max_height)
    ends = rows.groupBy("site").agg(F.max("t").alias("_hi"), F.count("*").alias("_many"))
    rows = facts.joined(rows, settle(ends), ["site"], "_many", rows.count())
    rows = (rows if request.hours is None else rows.where(F.col("t") >= F.col("_hi") - int(request.hours * HOUR))).drop("_hi")
    rows = settle(compatible(rows.select("site", "t", "beta", "r", "quality"), ["site"]))
    sizes = rows.groupBy("site").agg(F.count("*").alias("_many"), F.max(F.size("r")).alias("_wide"))
    part = lambda many, most: F.greatest(F.ceil(F.col(many) / most), F.lit(1)).cast("int")
    sizes = settle(sizes.select("site", "_many", part("_many", request.max_rows).alias("_rows"), part("_wide", request.max_gates).alias("_cells")))
    return drawn(downsampled(facts.joined(rows, sizes, ["site"], "_many", rows.count()), "_rows", "_cells", ["site"]), request.vmin, request.vmax)


def scale_hints(cells: DataFrame) -> dict[str, float | None]:
    """Percentiles of the logarithm of positive cells."""
    logs = cells.select(F.explode("beta").alias("v")).where("v > 0").select(F.log10("v").alias("v"), F.lit(0).alias("one"))
    row = exact_percentiles(logs, ["one"], "v", {"p01": 0.01, "p50": 0.5, "p99": 0.99}).first()
    return {k: None if row is None else row[k] for k in ("p01", "p50", "p99")}


def drawn(cells: DataFrame, vmin: float, vmax: float) -> DataFrame:
    """Cells with codes, a byte each."""
    return cells.withColumn("codes", F.transform("beta", lambda v: fn.quantise(v, vmin, vmax)))


def by_track(layers: DataFrame) -> DataFrame:
    """(type, track, points): the points of each track in order of time; a layer without a track is one of its own. A window's
    points are bounded by its rows."""
    alone = F.concat_ws(":", F.col("t").cast("string"), F.col("base").cast("string"), "type")
    points = F.array_sort(F.collect_list(F.struct("t", "base", "top", "confidence", "interpolated")))
    return layers.groupBy("type", F.coalesce("track", alone).alias("track")).agg(points.alias("points"))


def legend(layers: DataFrame) -> DataFrame:
    """How many bases and tops each type has."""
    return layers.groupBy("type").agg(F.count("*").alias("n"), F.count("base").alias("bases"), F.count("top").alias("tops"), F.count_if("interpolated").alias("interpolated"))


def assembled(store: Store, request: Request = Request()) -> tuple[dict, DataFrame | None]:
    """Header and cells (row, t, quality, codes) of a site's window; with nothing stored, an empty header and None."""
    site = request.site
    sites = store.sites() if site is None else [site]
    if len(sites) > 1:
        raise ValueError(f"name one of the sites stored: {', '.join(map(str, sites[:20]))}")
    hi = store.latest(site)
    nothing = {"version": VERSION, "site": site, "shape": [0, 0], "time": [], "range": [], "quality": [], "layers": {}, "first_t": None, "last_t": None, "percentiles": {"p01": None, "p50": None, "p99": None}, "factors": [1, 1], "full_shape": [0, 0]}
    if hi is None:
        return nothing, None
    rows = compatible(store.window(hours=request.hours, max_height=request.max_height, site=site))
    full = rows.agg(F.count("*").alias("n"), F.max(F.size("r")).alias("gates"), F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    row_factor, gate_factor = factors(full["n"], full["gates"], request.max_rows, request.max_gates)
    cells = drawn(downsampled(rows.select("t", "beta", "r", "quality"), row_factor, gate_factor), request.vmin, request.vmax).select("row", "t", "r", "quality", "beta", "codes")
    told = cells.select("row", "t", "quality").orderBy("row").collect()  # at most max_rows
    heights = cells.select("r").orderBy("row").first()["r"]
    layers = {}
    if request.layers and store.layer_table.rows() is not None:
        found = store.layers(full["lo"], full["hi"], least=request.least, site=site).withColumn("seconds", F.col("t") / 1e6)
        if found.limit(request.max_points + 1).count() > request.max_points:
            raise ValueError(f"more than {request.max_points} points of layers: ask for fewer hours or surer layers")
        for r in aggregates.parallel_arrays(found, ["type"], ["seconds", "base"], {"seconds": 1, "base": 1, "top": 1, "confidence": 3, "track": 0, "interpolated": 0}).collect():
            layers[r["type"]] = {k: r[k] for k in ("seconds", "base", "top", "confidence", "track", "interpolated")}
    header = {
        "version": VERSION, "site": site if site is not None else (sites or [None])[0], "shape": [len(told), len(heights)], "encoding": {"scale": "log10", "vmin": request.vmin, "vmax": request.vmax, "missing": 0},
        "time": [r["t"] / 1e6 for r in told], "range": heights, "quality": [r["quality"] for r in told], "factors": [row_factor, gate_factor], "full_shape": [full["n"], full["gates"]],
        "first_t": full["lo"], "last_t": full["hi"], "percentiles": scale_hints(cells), "layers": layers,
    }
    return header, cells


def payload(header: dict, cells: DataFrame | None, binary: bool = False) -> bytes:
    """The window as JSON with its bytes in base 64, or as a frame: magic, version, length of the header, header, bytes."""
    raw = b"" if cells is None else b"".join(bytes(r["codes"]) for r in cells.select("row", "codes").orderBy("row").collect())  # at most max_rows
    if not binary:
        return json.dumps(header | {"data": b64encode(raw).decode()}).encode()
    head = json.dumps(header).encode()
    return MAGIC + bytes([VERSION]) + struct.pack("<I", len(head)) + head + raw


def split_runs(layers: DataFrame) -> DataFrame:
    """Points with run, which grows where a track turns from measured to interpolated or back."""
    return frames.change_runs(layers, "track", ["t"], "interpolated")


def latest_layers(store: Store, site=None) -> DataFrame:
    """A site's layers of its latest profile, the lowest first."""
    hi = store.latest(site)
    return store.layers(hi - HOUR // 7200, hi + HOUR // 7200, site=site).orderBy("base", "type")
