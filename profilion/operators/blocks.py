"""Frames worked out in blocks of rows, as matrices or vectors in Arrow batches: box means over rows and gates, sorted windows for medians,
frames whose width is a column.

Rows are numbered along their keys and dealt by blocks with a halo of as many rows as a frame reaches (``frames.numbered``,
``frames.haloed``), so each block is a task's work by itself, whatever a key's length. What the halo brings is
bounded by the frame; only the columns that a frame reads go with it."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.types import _parse_datatype_string as parsed

from profilion.operators import frames


def in_blocks(rows: DataFrame, keys: list[str], at: str, ties: list[str], half: int, made: str, run: Callable[[pa.Table], dict], needs: list[str], size: int = frames.BLOCK, width: int = frames.WIDTH) -> DataFrame:
    """Rows with the columns ``made`` (name type, ...): run takes a block's rows in order, halo included, and gives an array for each of
    them. Of the halo's columns only ``needs`` are read; i and n tell a row's place along its keys and how many rows they have."""
    size = max(size, 2 * half)
    spaced = frames.haloed(frames.numbered(rows, keys, at, ties, width), half, size)
    wide = [f.name for f in rows.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType) and f.name not in (*keys, *needs)]
    spaced = spaced.withColumns({c: F.when(F.col("_home"), F.col(c)) for c in wide}) if wide else spaced
    names = rows.columns

    def each(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("i", "ascending")]))
        home = table.column("_home")
        columns = run(table)
        out = table.select(names)
        for name, values in columns.items():
            out = out.append_column(name, values if isinstance(values, pa.Array | pa.ChunkedArray) else pa.array(values, from_pandas=True))
        return out.filter(home)

    return spaced.groupBy(*keys, "_block").applyInArrow(each, StructType([*rows.schema.fields, *parsed(made).fields]))


def vector(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, missing ones NaN."""
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def matrix(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays as a matrix, missing values and places beyond an array's end NaN; and how long each array is."""
    column = table.column(name).combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lengths), int(lengths.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out, lengths


def arrays(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    """Rows of a matrix as arrays of these lengths; NaN as NULL."""
    inside = np.arange(values.shape[1]) < lengths[:, None]
    flat = values[inside]
    missing = np.isnan(flat) if flat.dtype.kind == "f" else None
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat, kind, mask=missing))


def running_sums(values: np.ndarray, half: int, axis: int) -> np.ndarray:
    """Sums of the values within half of each along an axis, cut short at the ends: differences of one running sum."""
    n = values.shape[axis]
    total = np.insert(np.cumsum(values, axis=axis, dtype=np.longdouble), 0, 0, axis=axis)
    hi, lo = np.minimum(np.arange(n) + half + 1, n), np.maximum(np.arange(n) - half, 0)
    return (np.take(total, hi, axis=axis) - np.take(total, lo, axis=axis)).astype(float)


def box_means(values: np.ndarray, half_rows: int, half_places: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the values that are there in a box around each cell (NaN without any), and how many they are."""
    there = ~np.isnan(values)
    total, count = np.where(there, values, 0.0), there.astype(float)
    for axis, half in ((1, half_places), (0, half_rows)):
        total, count = running_sums(total, half, axis), np.rint(running_sums(count, half, axis))
    return np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0), count


def boxed(profiles: DataFrame, keys: list[str], at: str, values: str, half_rows: int | str, half_places: int | str, mean: str = "mean", n: str = "n_values", size: int = 512, width: int = frames.WIDTH) -> DataFrame:
    """Profiles with the box mean of an array column over rows and places, and how many values it is of; both as arrays. Rows are counted
    along keys; equal times follow one another. Half widths may be columns, which are the same for all rows of a key. Profiles
    move as arrays, with a halo of half the widest box."""
    widths = {"rows": half_rows, "places": half_places}
    named = [v for v in widths.values() if isinstance(v, str)]
    most = half_rows if isinstance(half_rows, int) else profiles.agg(F.max(half_rows)).first()[0] or 0

    def run(table: pa.Table) -> dict:
        cells, lengths = matrix(table, values)
        half = {k: table.column(v)[0].as_py() if isinstance(v, str) else v for k, v in widths.items()}
        means, counts = box_means(cells, half["rows"], half["places"])
        return {mean: arrays(means, lengths), n: arrays(counts, lengths, pa.int64())}

    return in_blocks(profiles, keys, at, [], int(most), f"{mean} array<double>, {n} array<long>", run, [values, *named], size, width)


def sorted_medians(values: np.ndarray, half: int) -> np.ndarray:
    """Median of the values within half of each (NaN: missing, left out): a sorted window slides along, one value in, one out."""
    window: list[float] = []
    out, n = np.full(len(values), np.nan), len(values)
    for k in range(-half, n):
        if k + half < n and (v := values[k + half]) == v:
            insort(window, v)
        if k - half - 1 >= 0 and (v := values[k - half - 1]) == v:
            del window[bisect_left(window, v)]
        if k >= 0 and window:
            m = len(window)
            out[k] = (window[(m - 1) // 2] + window[m // 2]) / 2.0
    return out


def running_median(rows: DataFrame, key: str, order: list[str], value: str, half: int, out: str = "median", size: int = frames.BLOCK, width: int = frames.WIDTH) -> DataFrame:
    """Median of the rows there are within half of each."""
    return in_blocks(rows, [key], order[0], order[1:], half, f"{out} double", lambda t: {out: sorted_medians(vector(t, value), half)}, [value], size, width)


def spans(half: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each frame, and the one after its last, cut short at the ends; a missing width is a frame of nothing."""
    known, at = ~np.isnan(half), np.arange(n)
    reach = np.where(known, half, 0).astype(np.int64)
    lo = np.clip(at - reach, 0, n)
    return lo, np.where(known, np.clip(at + reach + 1, lo, n), lo)


def means_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Means over frames of any widths, by differences of running sums."""
    there = ~np.isnan(values)
    total = np.append(0, np.cumsum(np.where(there, values, 0.0), dtype=np.longdouble))
    count = np.append(0, np.cumsum(there))
    n = count[hi] - count[lo]
    return np.divide((total[hi] - total[lo]).astype(float), n, out=np.full(len(lo), np.nan), where=n > 0)


def least_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least values over frames of any widths, by a sparse table: two overlapping stretches of a power of two make a frame."""
    filled = np.where(np.isnan(values), np.inf, values)
    levels = [filled]
    while 2 << len(levels) - 1 <= len(values):
        before, step = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(before[:-step], before[step:]))
    wide = np.maximum(hi - lo, 1)
    level = np.frexp(wide)[1] - 1
    out = np.full(len(lo), np.inf)
    for k, table in enumerate(levels):
        mine = np.flatnonzero((level == k) & (hi > lo))
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k)])
    return np.where(np.isinf(out), np.nan, out)


def ranging(rows: DataFrame, keys: list[str], order: list[str], value: str, half: str, mean: str = "mean", least: str = "least", size: int = frames.BLOCK, width: int = frames.WIDTH) -> DataFrame:
    """Mean and least value of the rows within ``half`` of each, a column: every row, and so every site, may have a width of its own. The halo
    is as wide as the widest frame; a width that is NULL or negative gives NULLs."""
    most = rows.agg(F.max(half)).first()[0] or 0

    def run(table: pa.Table) -> dict:
        values, reach = vector(table, value), vector(table, half)
        lo, hi = spans(np.where(reach < 0, np.nan, reach), len(values))
        return {mean: means_of(values, lo, hi), least: least_of(values, lo, hi)}

    return in_blocks(rows, keys, order[0], order[1:], int(most), f"{mean} double, {least} double", run, [value, half], size, width)
