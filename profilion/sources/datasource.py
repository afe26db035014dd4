"""Logs of messages and gridded text as Spark data sources, for ``spark.read.format`` and for SQL.

After ``register(spark)``::

    spark.read.format("profilion_messages").load(folder).where("t >= 1767225600000000")
    CREATE TEMPORARY VIEW logs USING profilion_messages OPTIONS (path '...', unit '1e-9')

A file is read in ranges of bytes (option ``range_bytes``), each by its own task. A message belongs to the range that holds its
opening character, a line to the range that holds its first byte; a task reads on beyond its range to the end of its last one,
and back before it for the time stamp of its first one, so ranges of any size give the same rows. Bounds on ``t``, and equality
and lists on ``path``, are pushed into the source: files are left out, and a row is timed before its profile is decoded. Only
the columns of a schema given to ``.schema()`` are decoded.

Files are opened by Arrow's file systems (local, HDFS, S3, GCS) on the executors; nothing of a file goes through the driver but its name
and size. Messages without a time stamp have t NULL: ``messages.fill_times`` needs the whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from profilion.functions.profiles import QUALITY
from profilion.sources.gridded import FormatError
from profilion.sources.messages import CLOSES, FULL_SCALE, OPENS, SHORTEST, STAMP

RANGE_BYTES, PIECE = 64 << 20, 1 << 20
MESSAGES = "path string, place long, t long, beta array<double>, r array<double>, quality long, status string, window double, mode string, background double, cloud_base_reported array<double>, vertical_visibility double, alarm string, crc_ok boolean"
GRIDDED = "path string, place long, t long, beta array<double>, r array<double>, quality long, range_corrected boolean, background_subtracted boolean, meta map<string,string>"


@dataclass
class Range(InputPartition):
    """Bytes lo to hi of a file of so many."""

    path: str
    lo: int
    hi: int
    size: int


@dataclass
class Bounds:
    """What has been pushed: t from lo to hi, both included, and the paths, if they are told."""

    lo: int = -(2**63)
    hi: int = 2**63 - 1
    paths: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Whether a filter is wholly seen to."""
        if f.attribute == ("t",):
            if isinstance(f, IsNotNull):
                return False  # a bound on t leaves out NULL as well
            if isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, f.value), min(self.hi, f.value)
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThanOrEqual | LessThan):
                self.hi = min(self.hi, f.value - isinstance(f, LessThan))
            else:
                return False
            return True
        if f.attribute == ("path",) and isinstance(f, EqualTo | In):
            told = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.paths = told if self.paths is None else self.paths & told
            return True
        return False

    @property
    def bound(self) -> bool:
        return self.lo > -(2**63) or self.hi < 2**63 - 1

    def holds(self, t: int | None) -> bool:
        return self.lo <= t <= self.hi if t is not None else not self.bound


def opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    return system, inner


def listed(path: str) -> list[tuple[str, int]]:
    """Files of a path or of all below it, with their sizes; hidden ones are left out, as elsewhere in Spark."""
    system, inner = opened(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FormatError(f"no such file or folder: {path}")
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    files = [found] if found.is_file else [x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file]
    hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(inner) :].strip("/").split("/"))
    return sorted((head + x.path, x.size) for x in files if found.is_file or not hidden(x.path))


class RangeReader(DataSourceReader):
    """Files by ranges; ``rows`` gives the rows of one."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options, self.bounds = schema, {k.lower(): v for k, v in options.items()}, Bounds()
        if "path" not in self.options:
            raise FormatError("a path is needed: load(path) or OPTIONS (path '...')")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> list[Range]:
        width = max(int(self.options.get("range_bytes", RANGE_BYTES)), 1)
        found = []
        for path, size in listed(self.options["path"]):
            if self.bounds.paths is None or path in self.bounds.paths:
                step = width if self.splits(path) else max(size, 1)
                found += [Range(path, lo, min(lo + step, size), size) for lo in range(0, size, step)]
        return found or [Range("", 0, 0, 0)]

    def splits(self, path: str) -> bool:
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds, held = to_arrow_schema(self.schema), []
        wanted = {f.name for f in self.schema.fields}
        if partition.size:
            for row in self.rows(partition, wanted):
                held.append({k: row.get(k) for k in kinds.names})
                if len(held) == 500:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


# -- messages


def records(file, lo: int, hi: int) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(place, record, what stands before it, whether that is a record too) of the records that open within lo and hi: a record lasts
    until the next one opens."""
    mark = OPENS.encode()
    before, at = b"", lo
    while at > 0 and mark not in before:  # back to the record before, or the file's beginning
        step = max(at - PIECE, 0)
        file.seek(step)
        before, at = file.read(at - step) + before, step
    follows, before = mark in before, before.rsplit(mark, 1)[-1]
    file.seek(lo)
    held, start, place = b"", lo, None
    while True:
        piece = file.read(PIECE)
        held += piece
        while (cut := held.find(mark)) >= 0:
            if place is None:
                before += held[:cut]
            else:
                yield place, held[:cut], before, follows
                before, follows = held[:cut], True
            place, start, held = start + cut, start + cut + 1, held[cut + 1 :]
            if place >= hi:
                return
        if not piece or (place is None and start + len(held) >= hi):
            break
    if place is not None:
        yield place, held, before, follows


def split(record: bytes) -> list[str]:
    return re.split("\r\n?|\n", record.decode("latin-1"))


def stamp_of(lines: list[str]) -> str | None:
    """The last time stamp of some lines."""
    return next((m[1] for x in reversed(lines) if (m := re.match(STAMP, x.strip()))), None)


def end_of(lines: list[str]) -> int:
    """How many lines are the message's: it ends with its closing line or before a time stamp after three lines."""
    closing = next((k + 1 for k, x in enumerate(lines) if x.startswith(CLOSES)), len(lines))
    return next((k for k in range(4, closing) if re.match(STAMP, lines[k].strip())), closing)


def micros(stamp: str | None) -> int | None:
    """Microseconds of ISO 8601, without zone in UTC, or of seconds; None of anything else."""
    try:
        return int(float(stamp) * 1e6)
    except (TypeError, ValueError, OverflowError):
        pass
    try:
        at = datetime.fromisoformat(stamp)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    since = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds


def counts(digits: str, n: int) -> np.ndarray:
    """Fields of five hex digits, 20 bits with a sign."""
    raw = np.frombuffer(digits[: 5 * n].upper().encode(), np.uint8).astype(np.int64)
    values = np.where(raw >= 65, raw - 55, raw - 48).reshape(n, 5) @ (16 ** np.arange(4, -1, -1))
    return np.where(values >= 1 << 19, values - (1 << 20), values)


CRC = []
for _k in range(256):
    for _ in range(8):
        _k = _k >> 1 ^ (0x8408 if _k & 1 else 0)
    CRC.append(_k)


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = crc >> 8 ^ CRC[(crc ^ byte) & 255]
    return crc ^ 0xFFFF


def number(tokens: list[str], k: int) -> float | None:
    try:
        return float(int(tokens[k]))
    except (IndexError, ValueError):
        return None


class MessageReader(RangeReader):
    def rows(self, part: Range, wanted: set[str]) -> Iterator[dict]:
        unit, strict = float(self.options.get("unit", 1e-9)), self.options.get("strict", "false").lower() == "true"
        system, inner = opened(part.path)
        with system.open_input_file(inner) as file:
            for place, record, before, follows in records(file, part.lo, part.hi):
                earlier = split(before)
                t = micros(stamp_of(earlier[end_of(earlier) if follows else 0 :]))
                lines = split(record) if self.bounds.holds(t) else []
                if lines and (row := decoded(lines[: end_of(lines)], wanted, unit, strict)):
                    yield row | {"path": part.path, "place": place, "t": t}


def decoded(lines: list[str], wanted: set[str], unit: float, strict: bool) -> dict | None:
    """A message's columns, as far as they are wanted; None without a line of digits."""
    at = next((k for k, x in enumerate(lines) if re.fullmatch(f"[0-9A-Fa-f]{{{SHORTEST},}}", x.strip())), 0)
    if at < 2:
        return None
    digits, status, p = lines[at].strip(), lines[1].strip(), lines[at - 1].strip().split()
    s, kind = status[2:].split(), status[:1]
    n = int(number(p, 2) or 0)
    n = n if 0 < n <= len(digits) // 5 else len(digits) // 5
    row = {"status": status, "window": number(p, 6), "mode": p[7] if len(p) > 7 else None, "background": number(p, 8)}
    row["cloud_base_reported"] = [number(s, k) if k < len(s) and len(s[k]) < 8 else None for k in range(min(int(kind), len(s)))] if kind in ("1", "2", "3") else None
    row["vertical_visibility"] = number(s, 0) if kind in ("4", "5") else None
    row["alarm"] = s[-1] if s and re.fullmatch("[0-9A-Fa-f]{8}", s[-1]) else None
    if strict or "crc_ok" in wanted:
        told = next((x for x in lines[at + 1 :] if x.startswith(CLOSES)), None)
        body = "\r\n".join(lines[: at + 1]) + "\r\n" + CLOSES
        row["crc_ok"] = None if told is None else bool(re.fullmatch("[0-9A-Fa-f]{4}", told[1:5])) and int(told[1:5], 16) == crc16(body.encode("latin-1"))
    if wanted & {"beta", "quality"}:
        values = counts(digits, n)
        scale = number(p, 0) or 0
        row["beta"] = (values * unit * (100.0 / (scale if scale > 0 else 100.0))).tolist()
        flags = {"instrument_warning": status[1:2].upper() == "W", "instrument_alarm": status[1:2].upper() == "A", "fog": kind == "4", "low_snr": kind == "/" or (strict and row["crc_ok"] is False), "window_contaminated": (row["window"] or 0) > 2000, "saturated": bool((np.abs(values) >= FULL_SCALE).any())}
        row["quality"] = sum(QUALITY[k] for k, there in flags.items() if there)
    if "r" in wanted:
        apart = number(p, 1) or 0
        row["r"] = ((np.arange(n) + 0.5) * (apart if apart > 0 else 10.0)).tolist()
    return row


# -- gridded text


def lines_of(file, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a file from where it stands, place ``at``, on."""
    held = b""
    while True:
        piece = file.read(PIECE)
        held += piece
        *lines, held = held.split(b"\n") if piece else [*held.split(b"\n"), b""]
        for line in lines:
            yield at, line
            at += len(line) + 1
        if not piece:
            return


def head_of(file) -> tuple[list[str], str, int]:
    """The notes above a file's header, the header, and where the rows begin."""
    notes = []
    for at, line in lines_of(file):
        text = line.decode("utf-8", "replace").rstrip()
        if text and not text.startswith("#"):
            return notes, text, at + len(line) + 1
        notes.append(text)
    return notes, "", 0


class GridReader(RangeReader):
    def splits(self, path: str) -> bool:
        return not path.endswith((".gz", ".bz2", ".zst"))

    def rows(self, part: Range, wanted: set[str]) -> Iterator[dict]:
        scale, (system, inner) = float(self.options.get("scale", 1.0)), opened(part.path)
        with system.open_input_stream(inner, compression="detect") as file:
            notes, header, first = head_of(file)
        told = {m[1].lower(): m[2] for x in notes if (m := re.match(r"#\s*([^=:]+?)\s*[=:]\s*(.*)$", x))}
        try:
            ranges = [float(x) for x in header.split(",")[1:]]
        except ValueError:
            ranges = []
        if not ranges:
            raise FormatError(f"{part.path}: no header of a time and numbers")
        true = lambda k: told.get(k, "").lower() in ("1", "true", "yes", "y", "on")
        fixed = {"path": part.path, "r": ranges, "quality": 0, "range_corrected": true("range_corrected"), "background_subtracted": true("background_subtracted"), "meta": list(told.items())}
        if self.splits(part.path):
            lo, hi = max(part.lo, first), part.hi
            file = system.open_input_file(inner)
            file.seek(lo - 1)  # the rest of the line before, which may be no more than its line feed
            lines = ((at, line) for at, line in lines_of(file, lo - 1) if at >= lo)
        else:
            hi, file = 1 << 62, system.open_input_stream(inner, compression="detect")
            lines = ((at, line) for at, line in lines_of(file) if at >= first)
        with file:
            for place, line in lines:
                if place >= hi:
                    return
                stamp, _, rest = line.partition(b",")
                t = micros(stamp.decode("utf-8", "replace").strip())
                if t is not None and self.bounds.holds(t):
                    row = fixed | {"place": place, "t": t}
                    if "beta" in wanted:
                        row["beta"] = cells(rest.decode("utf-8", "replace").rstrip(), len(ranges), scale)
                    yield row


def cells(text: str, n: int, scale: float) -> list[float | None]:
    """So many cells; blank, bad and NaN ones are None, and those that a row has not got."""

    def value(x: str) -> float | None:
        try:
            v = float(x) * scale
        except ValueError:
            return None
        return v if v == v else None

    found = [value(x) for x in text.split(",")[:n]]
    return found + [None] * (n - len(found))


class MessageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "profilion_messages"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return MessageReader(schema, dict(self.options))


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "profilion_grid"

    def schema(self) -> str:
        return GRIDDED

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets it push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MessageSource, GridSource):
        spark.dataSource.register(source)
