"""Made-up hours of profiles with layers that are known, for tests: a table of slabs, drawn on a grid of times and heights.

A slab is a stretch of hours whose lower and upper edge go in straight lines between given points and are soft; what it holds is added
up. The instrument loses light on both ways through a slab, sees little near the ground and adds noise."""

from dataclasses import dataclass

import numpy as np
import pandas as pd

HOUR = 3_600_000_000
#: kind, hours (from, to), points (hour, lower edge), points (hour, upper edge), backscatter, softness of both edges, light lost a unit of backscatter.
SLABS = (
    ("mixing", (0, 24), ((0, 0), (24, 0)), ((0, 280), (6, 300), (10, 900), (14, 1650), (18, 1650), (20, 320), (24, 280)), 5e-6, (1, 40), 30),
    ("residual", (0, 9), ((0, 300), (9, 700)), ((0, 1500), (9, 1380)), 2.2e-6, (60, 70), 30),
    ("residual", (20.2, 24), ((20, 400), (24, 300)), ((20, 1600), (24, 1520)), 2.2e-6, (60, 70), 30),
    ("haze", (0, 16), ((0, 2500), (16, 2150)), ((0, 3150), (16, 2850)), 2e-6, (60, 90), 30),
    ("cloud", (8.5, 11), ((8, 1950), (11, 1900)), ((8, 2050), (11, 2000)), 2.5e-3, (12, 30), 18),
    ("fog", (3, 4.5), ((3, 0), (5, 0)), ((3, 280), (5, 280)), 4e-4, (1, 60), 30),
    ("rain", (21, 22), ((21, 0), (22, 0)), ((21, 1200), (22, 1200)), 3.2e-5, (1, 120), 12),
)


@dataclass(frozen=True)
class Grid:
    gates: int = 770
    apart: float = 10.0
    every: float = 30.0
    noise: float = 8e-8
    speckle: float = 0.02


def edge(points, hour):
    return np.interp(hour, *np.array(points, float).T)


def day(start, hours, grid=Grid(), site="made", seed=1):
    """A pandas table of site, t, r, beta, quality, range_corrected, and what is there: (kind)_base, (kind)_top and (kind)_visible, fog,
    rain, screened."""
    rng = np.random.default_rng(seed)
    t = start + (np.arange(int(hours * 3600 / grid.every)) * grid.every * 1e6).astype(np.int64)
    hour, h = t % (24 * HOUR) / HOUR, (np.arange(grid.gates) + 0.5) * grid.apart
    total, lost = np.tile(2e-7 * np.exp(-h / 7000), (len(t), 1)), np.zeros((len(t), grid.gates))
    out = {}
    for kind, (lo, hi), low, high, amount, (soft_low, soft_high), dims in SLABS:
        there = (hour >= lo) & (hour < hi)
        base, top = edge(low, hour), edge(high, hour)
        inside = 0.5 * (np.tanh((h - base[:, None]) / soft_low) - np.tanh((h - top[:, None]) / soft_high)) if base.any() else 0.5 * (1 - np.tanh((h - top[:, None]) / soft_high))
        part = np.where(there[:, None], amount * inside, 0)
        total, lost = total + part, lost + part * dims
        for name, value in (("base", base), ("top", top)):
            out[f"{kind}_{name}"] = np.where(there, value, out.get(f"{kind}_{name}", np.nan))
    # the mixing layer swallows the residual layer
    gone = out["residual_top"] < out["mixing_top"] + 150
    out["residual_top"] = np.where(gone, np.nan, out["residual_top"])
    near = np.clip((h - 15) / 165, 0, 1) ** 1.6
    seen = total * np.exp(-2 * np.cumsum(lost * grid.apart, axis=1)) * near
    beta = seen * (1 + grid.speckle * rng.standard_normal(seen.shape)) + grid.noise * (h / 1000) ** 2 * rng.standard_normal(seen.shape)
    fog, rain = (~np.isnan(out[f"{k}_top"]) for k in ("fog", "rain"))
    screened, cloud = fog | rain, out["cloud_base"]
    table = pd.DataFrame({"site": site, "t": t, "quality": 0, "range_corrected": True, "fog": fog, "rain": rain, "screened": screened})
    table["r"], table["beta"] = [h.tolist()] * len(t), beta.tolist()
    for kind, height in (("mixing", "top"), ("residual", "top"), ("haze", "base"), ("haze", "top"), ("cloud", "base")):
        value = np.where(fog, np.nan, out[f"{kind}_{height}"])
        table[f"{kind}_{height}"] = pd.Series(value).astype(object).where(~np.isnan(value), None)
        table[f"{kind}_visible"] = ~screened & ~np.isnan(value) & (np.isnan(cloud) | (kind == "cloud") | (value < cloud - 50))
    return table


SCHEMA = "site string, t long, quality long, range_corrected boolean, fog boolean, rain boolean, screened boolean, r array<double>, beta array<double>, " + ", ".join(
    f"{k}_{c} {'boolean' if c == 'visible' else 'double'}" for k, c in (("mixing", "top"), ("mixing", "visible"), ("residual", "top"), ("residual", "visible"), ("haze", "base"), ("haze", "visible"), ("haze", "top"), ("cloud", "base"), ("cloud", "visible"))
)


def made(spark, start, hours, **how):
    table = day(start, hours, **how)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame(table[names].astype(object).values.tolist(), SCHEMA).repartition(8)
