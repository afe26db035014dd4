"""Readers by name or by the look of a file, and one call that reads any of them.

What a file looks like is decided in Spark: the first bytes of every file are read where tasks run, and each format's look is a
column expression over them. Nothing else of a file is read, whatever its size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.sources import gridded, messages
from profilion.sources.datasource import opened
from profilion.sources.gridded import FormatError

#: Bytes of a file that are looked at, and files of a mixed input that may be named one by one.
HEAD, NAMED = 8192, 100_000


@dataclass(frozen=True)
class Format:
    """A kind of file. looks: whether a head (as text, a character for each byte) is of this kind. names: a pattern of the names that such
    files mostly have, which decides where several kinds look right. read(spark, paths, **options) gives t, beta, r and others."""

    name: str
    description: str
    names: str
    looks: Callable[[Column], Column]
    read: Callable[..., DataFrame]


LOGGED = Format(
    "messages",
    "logged instrument messages, hexadecimal profiles",
    r"(?i)\.(dat|txt|raw)$",
    lambda head: head.contains("\x01CL") | head.contains("\x01CT") | (head.rlike(r"(?m)^[ \t]*-?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}") & head.rlike(r"(?m)^[ \t]*[0-9A-Fa-f]{100,}[ \t\r]*$")),
    messages.read,
)
GRIDDED = Format(
    "gridded",
    "text of rows of time and columns of range",
    r"(?i)\.csv(\.gz)?$",
    # its own comment, or comments and then a header that begins with the time, within twenty lines
    lambda head: head.rlike(rf"\A(?:#[^\n]*\n){{0,19}}{gridded.MAGIC}") | head.rlike(r"(?i)\A(?:#[^\n]*\n){0,19}[ \t]*time,"),
    gridded.read,
)
FORMATS: dict[str, Format] = {f.name: f for f in (LOGGED, GRIDDED)}


def add(form: Format) -> None:
    """Makes a further format known."""
    if form.name in FORMATS:
        raise ValueError(f"there is a format {form.name!r}: take another name, or remove it first")
    FORMATS[form.name] = form


def named(name: str) -> Format:
    try:
        return FORMATS[name]
    except KeyError:
        raise FormatError(f"no format {name!r}: {_choices()}") from None


def _choices() -> str:
    return "known are " + ", ".join(f"{f.name} ({f.description})" for _, f in sorted(FORMATS.items()))


def heads(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(path, length, head) of files, folders with all below them, and patterns. Compressed files are looked at from inside."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs).select("path", "length")  # without the content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                system, inner = opened(path)
                with system.open_input_stream(inner, compression="detect") as file:
                    out.append(file.read(HEAD).decode("latin-1"))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(out, pa.string())], ["path", "length", "head"])

    return found.mapInArrow(run, "path string, length long, head string")


def looked_at(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(path, length, form) of files; form is NULL where no format looks right."""
    candidates = [F.when(f.looks(F.col("head")), F.struct((~F.col("path").rlike(f.names)).alias("odd"), F.lit(k).alias("k"), F.lit(f.name).alias("name"))) for k, f in enumerate(FORMATS.values())]
    best = F.array_min(F.filter(F.array(*candidates), lambda c: c.isNotNull()))
    return heads(spark, inputs).select("path", "length", best["name"].alias("form"))


def by_format(spark: SparkSession, inputs: list[str], known_only: bool = False) -> dict[str, list[str]]:
    """Paths by format. An input whose files are all of one kind is named as a whole; of a mixed one, each file is. With known_only, files
    of no known format are left out."""
    out: dict[str, list[str]] = {}
    for one in inputs:
        files = looked_at(spark, [one])
        kinds = [r["form"] for r in files.select("form").distinct().collect()]  # a row for each format
        if None in kinds and not known_only:
            raise FormatError(f"no format looks right for {files.where('form IS NULL').first()['path']}: {_choices()}")
        if len(kinds) == 1 and kinds[0]:
            out.setdefault(kinds[0], []).append(one)
            continue
        rows = files.where("form IS NOT NULL").orderBy("path").limit(NAMED + 1).collect()
        if len(rows) > NAMED:
            raise FormatError(f"{one} mixes formats in more than {NAMED} files: name a folder or a pattern for each of them")
        for row in rows:
            out.setdefault(row["form"], []).append(row["path"])
    return out


def read(spark: SparkSession, inputs: str | list[str], form: str | None = None, known_only: bool = False, **options) -> DataFrame:
    """Profiles of all inputs, in the named format or each file in its own. Columns that a format has not got are NULL."""
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    found = {form: inputs} if form else by_format(spark, inputs, known_only)
    blocks = [named(name).read(spark, paths, **options) for name, paths in found.items()]
    if not blocks:
        raise FormatError("no files of a known format")
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    return out if "quality" in out.columns else out.withColumn("quality", F.lit(0).cast("long"))


def same_grid(profiles: DataFrame) -> DataFrame:
    """profiles, if all have one grid; else an error that names two of them."""
    grids = profiles.select(F.size("r").alias("gates"), F.get("r", F.lit(0)).alias("lowest"), F.array_max("r").alias("highest")).distinct().limit(2).collect()
    if len(grids) > 1:
        raise FormatError(f"profiles of several grids: {grids[0].asDict()}, {grids[1].asDict()}")
    return profiles
