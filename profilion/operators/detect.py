"""Layers of preprocessed profiles: edges by a multi-scale step transform, clouds by strength, and what they make up.

Rows are profiles: (site, t, r, beta, sigma, beta_smooth, sigma_smooth, quality), gates in arrays. The transforms of a batch of
profiles are numpy windows inside the tasks; all that follows from them (clustering, clouds, classes) are expressions on a
profile's row. The lowest cloud of neighbouring profiles is a frame over narrow rows, dealt by blocks. Screened profiles
have no layers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import blocks, frames, preprocess
from profilion.operators.preprocess import SITE, TIME

TINY = 1e-30


@dataclass(frozen=True)
class Settings:
    """The defaults, in metres, decades, per metre and steradian, and ratios."""

    scales: tuple[float, ...] = (60.0, 120.0, 240.0, 480.0, 960.0)
    significance: float = 3.0
    relative: float = 0.10
    least_step: float = 0.03
    lowest: float = 90.0
    highest: float = 5000.0
    merge: float = 150.0
    cloud: float = 1e-4
    cloud_gates: int = 2
    cloud_sharp: float = 8.0
    cloud_below: float = 300.0
    cloud_margin: float = 50.0
    opaque_snr: float = 2.0
    opaque_depth: float = 300.0
    surface_contrast: float = 1.15
    elevated_contrast: float = 2.0
    elevated_snr: float = 5.0
    haze_base: float = 800.0
    decoupling: float = 0.6
    elevated_depth: float = 200.0
    residual_depth: float = 500.0
    overlap_penalty: float = 0.6


CANDIDATES = "array<struct<strength:double,sign:int,height:double,amplitude:double,scale:double,refined:double>>"
EDGES = "array<struct<sign:int,height:double,refined:double,strength:double,amplitude:double,best_scale:double,scales:array<double>>>"
CLOUDS = "array<struct<base:double,top:double,peak_beta:double,peak_height:double,opaque:boolean,confidence:double>>"
LAYERS = "array<struct<type:string,base:double,top:double,confidence:double,meta:string>>"


# -- edges


def steps(field: np.ndarray, n: int) -> np.ndarray:
    """Half the difference of the means of n gates below each boundary and n above it; NaN where one is missing."""
    out = np.full(field.shape, np.nan)
    if field.shape[1] >= 2 * n:
        window = np.lib.stride_tricks.sliding_window_view(field, 2 * n, axis=1)
        out[:, n : n + window.shape[1]] = (window[..., :n].mean(axis=-1) - window[..., n:].mean(axis=-1)) / 2
    return out


def step_noise(sigma: np.ndarray, n: int) -> np.ndarray:
    """Standard deviation of ``steps`` for independent errors of gates."""
    out = np.full(sigma.shape, np.nan)
    if sigma.shape[1] >= 2 * n:
        window = np.lib.stride_tricks.sliding_window_view(sigma * sigma, 2 * n, axis=1)
        out[:, n : n + window.shape[1]] = np.sqrt(window.sum(axis=-1)) / (2 * n)
    return out


def found_edges(r: np.ndarray, ceiling: np.ndarray, fields: dict[str, np.ndarray], s: Settings) -> list[list[dict]]:
    """Candidates of each profile of one grid. fields: log and its error, linear and its error, and the overlap's error."""
    out: list[list[dict]] = [[] for _ in ceiling]
    dz = float(np.median(np.diff(r))) if len(r) > 1 else 1.0
    search = (r >= s.lowest) & (r <= np.minimum(s.highest, ceiling)[:, None])
    with np.errstate(invalid="ignore", divide="ignore"):
        for scale in s.scales:
            n = frames.half_width(scale, dz)
            w, noise = steps(fields["log"], n), np.hypot(step_noise(fields["log_error"], n), steps(fields["bias"] / np.log(10.0), n))
            plain, plain_noise = steps(fields["linear"], n), np.hypot(step_noise(fields["linear_error"], n), steps(fields["bias"] * np.nan_to_num(np.abs(fields["linear"])), n))
            band = search & np.isfinite(w) & (noise > 0)
            most = np.max(np.where(band, np.abs(w), 0.0), axis=1, initial=0.0)[:, None]
            for sign in (1, -1):
                v = sign * w
                peak = np.zeros(v.shape, bool)
                peak[:, 1:-1] = (v[:, 1:-1] > v[:, :-2]) & (v[:, 1:-1] >= v[:, 2:])
                hits = peak & band & (v / noise > s.significance) & (np.abs(w) >= s.relative * most) & (np.abs(w) >= s.least_step)
                for k, j in zip(*np.nonzero(hits), strict=True):
                    # the place of the largest plain step nearby, if that is significant as well
                    near = np.flatnonzero((r >= r[j] - scale / 2) & (r < r[j] + scale / 2) & np.isfinite(plain[k]))
                    best = near[np.argmax(sign * plain[k, near])] if len(near) else j
                    sure = len(near) and plain_noise[k, best] > 0 and sign * plain[k, best] / plain_noise[k, best] > s.significance / 2
                    out[k].append({"strength": float(v[k, j] / noise[k, j]), "sign": sign, "height": float(r[j]), "amplitude": float(abs(w[k, j])), "scale": float(scale), "refined": float(r[best] if sure else r[j])})
    return out


def edge_inputs(profiles: DataFrame, s: Settings = Settings(), p: preprocess.Settings = preprocess.Settings()) -> DataFrame:
    """Adds what edges are found in, as arrays of gates: _linear and _linear_error (left out near a cloud and above it), _log and
    _log_error, and _bias, the overlap's error. Needs r, ceiling (NULL: none), beta_smooth and sigma_smooth."""
    inside = lambda c: fn.clear_of_cloud(c, "r", "ceiling", s.cloud_margin)
    rows = profiles.withColumn("_linear", inside("beta_smooth")).withColumn("_linear_error", inside("sigma_smooth"))
    rows = rows.withColumn("_log", F.zip_with("_linear", "_linear_error", lambda b, e: fn.log_value(b, e))).withColumn("_log_error", F.zip_with("_linear", "_linear_error", lambda b, e: fn.log_error(b, e)))
    return rows.withColumn("_bias", F.transform("r", lambda h: (F.lit(1.0) - fn.overlap(h, p.overlap_start, p.overlap_full, p.overlap_shape)) * F.lit(p.overlap_error)))


#: The arrays that ``found_edges`` takes.
INPUTS = ("log", "log_error", "linear", "linear_error", "bias")
#: Profiles whose transforms and edges a task holds at a time; Arrow batches have up to 10,000.
PROFILES = 256


def gates_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays, which lie in its buffer where no gate is NULL (NaN); none for a NULL list."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False), ends[:-1])


def candidates(profiles: DataFrame, s: Settings = Settings(), p: preprocess.Settings = preprocess.Settings()) -> DataFrame:
    """Adds candidates, one for each extremum at each scale below the ceiling."""
    rows = edge_inputs(profiles, s, p)

    @F.pandas_udf(CANDIDATES)
    def edges(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in columns:
            for first in range(0, len(batch[0]), PROFILES):
                r, ceiling, *values = (c.iloc[first : first + PROFILES] for c in batch)
                out: list[list[dict]] = [[]] * len(r)
                grids = pd.Series([np.asarray(x, float).tobytes() for x in r])
                for _, at in grids.groupby(grids).indices.items():
                    m = [np.array([np.asarray(v.iloc[k], float) for k in at]) for v in values]
                    got = found_edges(np.asarray(r.iloc[at[0]], float), ceiling.iloc[at].to_numpy(float), dict(zip(INPUTS, m, strict=True)), s)
                    for k, x in zip(at, got, strict=True):
                        out[k] = x
                yield pd.Series(out)

    found = edges("r", F.coalesce("ceiling", F.lit(float("inf"))), *[f"_{c}" for c in INPUTS])
    return rows.withColumn("candidates", found).drop(*[f"_{c}" for c in INPUTS])


EDGE = "site string, t long, strength double, sign int, height double, amplitude double, scale double, refined double"


def register_edges(spark: SparkSession, s: Settings = Settings(), name: str = "profile_edges") -> None:
    """Makes edges a table function of SQL, over a table of ``edge_inputs``::

        SELECT e.* FROM profile_edges(TABLE(profiles)) e

    Batches of profiles go through it as Arrow tables, wherever they lie: nothing is shuffled. (Spark lets no Arrow table function stand
    behind LATERAL, so it takes the table itself.)"""

    @F.arrow_udtf(returnType=EDGE)
    class Edges:
        def eval(self, profiles: pa.RecordBatch) -> Iterator[pa.Table]:
            names = [f.split()[0] for f in EDGE.split(", ")]
            kinds = {"site": pa.string(), "t": pa.int64(), "sign": pa.int32()}
            for first in range(0, profiles.num_rows, PROFILES):
                some = profiles.slice(first, PROFILES)
                column = lambda c, some=some: some.column(some.schema.names.index(c))
                grids: dict[bytes, list[int]] = {}
                r = gates_of(column("r"))
                for k, heights in enumerate(r):
                    grids.setdefault(heights.tobytes(), []).append(k)
                values = {c: gates_of(column(f"_{c}")) for c in INPUTS}
                for at in grids.values():  # profiles of one grid together
                    fields = {c: np.array([values[c][k] for k in at]) for c in INPUTS}
                    ceiling = np.array([np.inf if (h := column("ceiling")[k].as_py()) is None else h for k in at])
                    named = [{"site": column("site")[k].as_py(), "t": column("t")[k].as_py()} for k in at]
                    found = [who | e for who, edges in zip(named, found_edges(r[at[0]], ceiling, fields, s), strict=True) for e in edges]
                    yield pa.table({c: pa.array([e[c] for e in found], kinds.get(c, pa.float64())) for c in names})

    spark.udtf.register(name, Edges)


def clustered(found: Column | str, s: Settings = Settings()) -> Column:
    """Candidates as edges: from the strongest on, each joins the first edge of its sign that is near enough, or is a new one;
    the finest scale says where an edge lies. Edges are in order of height."""
    order = lambda a, b: F.when(a["strength"] > b["strength"], -1).when(a["strength"] < b["strength"], 1).when(a["scale"] < b["scale"], -1).when(a["scale"] > b["scale"], 1).when(a["sign"] > b["sign"], -1).when(a["sign"] < b["sign"], 1).when(a["height"] < b["height"], -1).otherwise(1)

    def edge(sign, height, refined, strength, amplitude, best_scale, scales):
        return F.struct(sign.alias("sign"), height.alias("height"), refined.alias("refined"), strength.alias("strength"), amplitude.alias("amplitude"), best_scale.alias("best_scale"), scales.alias("scales"))

    def joined(e, x):
        finer = x["scale"] < e["best_scale"]
        pick = lambda a, b: F.when(finer, a).otherwise(b)
        return edge(e["sign"], pick(x["height"], e["height"]), pick(x["refined"], e["refined"]), F.greatest(e["strength"], x["strength"]), F.greatest(e["amplitude"], x["amplitude"]), F.least(e["best_scale"], x["scale"]), F.array_union(e["scales"], F.array(x["scale"])))

    def add(edges, x):
        near = F.transform(edges, lambda e: (e["sign"] == x["sign"]) & (F.abs(e["height"] - x["height"]) <= F.greatest(F.lit(s.merge), x["scale"] / 2)))
        at = F.array_position(near, True)
        new = edge(x["sign"], x["height"], x["refined"], x["strength"], x["amplitude"], x["scale"], F.array(x["scale"]))
        return F.when(at == 0, F.concat(edges, F.array(new))).otherwise(F.transform(edges, lambda e, i: F.when(i + 1 == at, joined(e, x)).otherwise(e))).cast(EDGES)

    ranked = F.array_sort(F.coalesce(found, F.array().cast(CANDIDATES)), order)
    edges = F.aggregate(ranked, F.array().cast(EDGES), add)
    by_height = F.array_sort(edges, lambda a, b: F.when(a["height"] < b["height"], -1).when(a["height"] > b["height"], 1).otherwise(0))
    return F.transform(by_height, lambda e: e.withField("height", e["refined"]))


# -- clouds


def runs(hit: Column) -> Column:
    """First and last place of each run of true values."""

    def ends(hit: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hit) - 1)
        first = F.filter(at, lambda i: F.get(hit, i) & ~F.coalesce(F.get(hit, i - 1), F.lit(False)))
        last = F.filter(at, lambda i: F.get(hit, i) & ~F.coalesce(F.get(hit, i + 1), F.lit(False)))
        return F.when(F.size(hit) > 0, F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))

    return fn.let(hit, ends)


def within(values: Column | str, r: Column | str, lo: Column, hi: Column) -> Column:
    """The values of gates from lo on and below hi."""
    r = fn.column(r)
    return F.filter(F.zip_with(values, r, lambda v, h: F.when((h >= lo) & (h < hi), v)), lambda v: v.isNotNull())


def fine_step(i: Column, n: Column) -> Column:
    """The plain step of beta at a gate; NULL where its window is not whole."""
    side = lambda first: F.aggregate(F.slice("beta", first, n), F.lit(0.0), lambda s, x: s + x)
    return F.when((i >= n) & (i + n <= F.size("beta")), (side(i - n + 1) - side(i + 1)) / (n * 2.0))


def cloud_base(first: Column, n: Column, s: Settings = Settings()) -> Column:
    """The height of the steepest rise of beta near the gate where a cloud begins."""
    h, scale = F.get("r", first), min(s.scales)
    near = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda i: (F.get("r", i) >= h - scale) & (F.get("r", i) < h + scale))
    rises = F.filter(F.transform(near, lambda i: F.struct(fine_step(i, n).alias("w"), i.alias("i"))), lambda x: x["w"].isNotNull())
    return F.coalesce(F.get("r", F.array_min(rises)["i"]), h)


def clouds(profiles: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds clouds, from the lowest gate on, at full resolution of time; none in screened profiles."""
    above = lambda b: F.coalesce(b > s.cloud, F.lit(False))
    n = F.greatest(F.rint(F.lit(min(s.scales)) / (preprocess.spacing("r") * 2.0)), F.lit(1.0)).cast("int")
    floor = F.coalesce(fn.array_median("sigma"), F.lit(TINY))
    strong = F.zip_with("beta", "r", lambda b, h: above(b) & (h >= s.lowest))
    found = F.filter(F.coalesce(runs(strong), F.array().cast("array<struct<first:int,last:int>>")), lambda x: x["last"] - x["first"] + 1 >= s.cloud_gates)

    def peaked(x):
        part = F.slice("beta", x["first"] + 1, x["last"] - x["first"] + 1)
        return F.struct(x["first"].alias("first"), F.array_max(part).alias("peak"), (x["first"] + F.array_position(part, F.array_max(part)).cast("int") - 1).alias("at"))

    def sharp(x, floor):
        h = F.get("r", x["first"])
        below = F.coalesce(fn.array_median(within("beta", "r", h - s.cloud_below, h)), F.lit(0.0))
        return x["peak"] >= F.greatest(below, floor * 3.0, F.lit(TINY)) * s.cloud_sharp

    def cloud(x, n):
        weak = F.filter(F.sequence(x["at"], F.size("beta") - 1), lambda i: ~above(F.get("beta", i)))
        return fn.let(F.struct(F.get("r", F.get(weak, F.lit(0))).alias("top")), lambda k: topped(x, k["top"], n))

    def topped(x, top, n):
        snr = F.zip_with("beta_smooth", "sigma_smooth", lambda b, e: b / F.when(e != 0, e))
        clear = F.coalesce(fn.array_median(within(snr, "r", top + 50.0, top + 50.0 + s.opaque_depth)) >= s.opaque_snr, F.lit(False))
        confidence = F.greatest(F.least(F.log10(F.greatest(x["peak"], F.lit(TINY)) / s.cloud) * 0.5 + 0.5, F.lit(1.0)), F.lit(0.5))
        return F.struct(cloud_base(x["first"], n, s).alias("base"), F.when(clear, top).alias("top"), x["peak"].alias("peak_beta"), F.get("r", x["at"]).alias("peak_height"), (~clear).alias("opaque"), confidence.alias("confidence"))

    made = fn.let(F.struct(n.alias("n"), floor.alias("floor")), lambda k: F.transform(F.filter(F.transform(found, peaked), lambda x: sharp(x, k["floor"])), lambda x: cloud(x, k["n"])).cast(CLOUDS))
    return profiles.withColumn("clouds", F.when(fn.screened("quality", wide=True), F.array().cast(CLOUDS)).otherwise(made))


def ceilings(profiles: DataFrame) -> DataFrame:
    """Adds ceiling, the lowest cloud base of the profiles within box_rows rows: as far as smoothing smears a cloud at that site."""
    base = F.array_min(F.transform("clouds", lambda c: c["base"]))
    least = blocks.ranging(profiles.select(SITE, TIME, "box_rows", base.alias("base")), [SITE], [TIME], "base", "box_rows")
    return profiles.drop("box_rows", "box_gates").join(least.select(SITE, TIME, F.col("least").alias("ceiling")), [SITE, TIME])


# -- classes


def contrast(inside: Column, outside: Column, noise: Column) -> Column:
    """How much stronger a layer is than what is outside, which counts as its noise at least."""
    return inside / F.greatest(F.coalesce(outside, F.lit(0.0)), F.coalesce(noise, F.lit(0.0)), F.lit(TINY))


def confidence(edge: Column, seen: Column, s: Settings = Settings(), overlap_full: float = 200.0) -> Column:
    """Strength, scales and contrast of an edge as one number from 0 to 1; less where the overlap is not full."""
    clear = F.greatest(F.least(F.log(F.greatest(F.coalesce(seen, F.lit(1.0)), F.lit(1.0))) / float(np.log(3.0)), F.lit(1.0)), F.lit(0.0))
    value = edge["strength"] / (edge["strength"] + s.significance) * 0.5 + F.size(edge["scales"]) * (0.3 / max(len(s.scales), 1)) + clear * 0.2
    return F.greatest(F.least(value * F.when(edge["height"] < overlap_full, s.overlap_penalty).otherwise(1.0), F.lit(1.0)), F.lit(0.0))


def classified(s: Settings = Settings(), overlap_full: float = 200.0) -> Column:
    """Layers of a profile with edges and clouds, from the ground up."""
    mean = lambda c, lo, hi: fn.array_mean(within(c, "r", lo, hi))
    lowest = F.lit(s.lowest)
    limit = F.least(F.lit(s.highest), F.array_min(F.transform("clouds", lambda c: c["base"])))
    tops = F.filter("edges", lambda e: (e["sign"] > 0) & (e["height"] < limit))
    bases = F.filter("edges", lambda e: (e["sign"] < 0) & (e["height"] < limit))
    probe = lambda e: F.greatest(e["best_scale"], F.lit(100.0))
    over = lambda c, e: mean(c, e["height"], e["height"] + probe(e))
    seen = lambda e, base: contrast(mean("beta_smooth", base, e["height"]), over("beta_smooth", e), over("sigma_smooth", e))

    def layer(kind, base, top, sure, **meta):
        return F.struct(kind.alias("type"), base.alias("base"), top.alias("top"), sure.alias("confidence"), F.to_json(F.struct(*[v.alias(k) for k, v in meta.items()])).alias("meta"))

    def on_ground(t):
        own_base = F.exists(bases, lambda b: (b["height"] > s.lowest) & (b["height"] < t["height"] - s.elevated_depth))
        return ~own_base & F.coalesce(seen(t, lowest) >= s.surface_contrast, F.lit(False))

    none = F.array().cast(LAYERS)
    clouds_ = F.transform("clouds", lambda c: layer(F.lit("cloud"), c["base"], c["top"], c["confidence"], peak_beta=c["peak_beta"], peak_height=c["peak_height"], opaque=c["opaque"])).cast(LAYERS)

    def grounded(mixing):
        one = lambda clear: F.array(layer(F.lit("mixing_layer"), F.lit(0.0), mixing["height"], confidence(mixing, clear, s, overlap_full), edge_strength=mixing["strength"], scales=F.array_sort(mixing["scales"]), contrast=clear, lowest_measured=lowest)).cast(LAYERS)
        return F.when(mixing.isNotNull(), fn.let(seen(mixing, lowest), one)).otherwise(none)

    def elevated(state, t):
        """Each value that later ones use is worked out once: the base, whether it is haze, the layer's means."""
        below = state["below"]
        own = F.filter(bases, lambda b: (b["height"] > below) & (b["height"] < t["height"] - s.elevated_depth))
        base = F.get(F.array_sort(own, lambda a, b: F.when(a["strength"] > b["strength"], -1).when(a["strength"] < b["strength"], 1).otherwise(0)), F.lit(0))

        def apart(base):
            gap = F.array_min(within("beta_smooth", "r", below, base["height"]))
            return F.coalesce((gap < mean("beta_smooth", base["height"], t["height"]) * s.decoupling) & (base["height"] >= s.haze_base), F.lit(False))

        def measured(base, haze):
            bottom = F.when(haze, base["height"]).otherwise(below)
            values = F.struct(bottom.alias("bottom"), seen(t, bottom).alias("clear"), mean("beta_smooth", bottom, t["height"]).alias("inside"), mean("sigma_smooth", bottom, t["height"]).alias("error"))
            return fn.let(values, lambda v: decided(base, haze, v))

        def decided(base, haze, v):
            snr = F.when(v["error"] > 0, v["inside"] / v["error"])
            good = F.coalesce((haze | (~state["residual"] & (t["height"] - v["bottom"] >= s.residual_depth))) & (v["clear"] >= s.elevated_contrast) & (snr >= s.elevated_snr), F.lit(False))
            weaker = F.when(haze & (base["strength"] < t["strength"]), base).otherwise(t)
            new = layer(F.when(haze, "haze").otherwise("residual_layer"), v["bottom"], t["height"], confidence(weaker, v["clear"], s, overlap_full), edge_strength=t["strength"], scales=F.array_sort(t["scales"]), contrast=v["clear"], snr=snr, decoupled=haze)
            return state_of(F.when(good, t["height"]).otherwise(below), state["residual"] | (good & ~haze), F.when(good, F.concat(state["layers"], F.array(new).cast(LAYERS))).otherwise(state["layers"]))

        found = fn.let(F.struct(base.alias("base")), lambda k: fn.let(apart(k["base"]), lambda haze: measured(k["base"], haze)))
        return F.when(t["height"] > below + s.elevated_depth, found).otherwise(state_of(below, state["residual"], state["layers"]))

    def state_of(below, residual, layers):
        return F.struct(below.alias("below"), residual.alias("residual"), layers.alias("layers"))

    def stacked(mixing):
        start = state_of(F.coalesce(mixing["height"], lowest), F.lit(False), none)
        return F.concat(clouds_, grounded(mixing), F.aggregate(tops, start, elevated)["layers"])

    mixing = F.struct(F.get(F.filter(tops, on_ground), F.lit(0)).alias("mixing"))
    return F.when(fn.screened("quality", wide=True), none).otherwise(fn.let(mixing, lambda k: stacked(k["mixing"])))


def detect(profiles: DataFrame, s: Settings = Settings(), p: preprocess.Settings = preprocess.Settings()) -> DataFrame:
    """Adds clouds, ceiling, edges and layers to preprocessed profiles."""
    rows = candidates(ceilings(clouds(preprocess.boxes(profiles, p), s)), s, p)
    rows = rows.withColumn("edges", clustered("candidates", s))
    return rows.withColumn("layers", classified(s, p.overlap_full)).drop("candidates")


def long_layers(detected: DataFrame) -> DataFrame:
    """(site, t, type, base, top, confidence, meta): a row for each layer."""
    return detected.select(SITE, TIME, F.explode("layers").alias("x")).select(SITE, TIME, "x.*")
