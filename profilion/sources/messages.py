"""Logged instrument messages as profiles, with built-in expressions only; and profiles as messages.

A log is read record by record, cut at the character that opens a message, so its size does not matter; only the time stamp
before a message is carried over to it, along the records of its file. A message without a profile line is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import scans

#: Control characters that open and close a message, and the shortest profile line.
OPENS, CLOSES, SHORTEST = "\x01", "\x03", 100
FULL_SCALE = 524287
STAMP = r"^-?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"
FIELDS = ("scale", "resolution", "n_gates", "laser_energy", "laser_temperature", "receiver", "window", "mode", "background", "total")


def records(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, place, modified, value): what lies between two opening characters of a log, and its order within the file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", OPENS)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    meta = F.col("_metadata")
    place = F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    return reader.text(paths).select(meta["file_path"].alias("path"), place.alias("place"), meta["file_modification_time"].alias("modified"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def split_messages(found: DataFrame, size: int = scans.BLOCK) -> DataFrame:
    """One row for each message of records: path, message (its number), stamp (text or NULL), modified, lines.

    A message ends with its closing line, or at a time stamp after three lines, or where the next one opens. What follows
    may hold the stamp of the next message; the last one there counts, and for that message alone."""
    lines = F.split("value", "\n")
    is_stamp = lambda x: F.trim(x).rlike(STAMP)
    closing = F.array_position(F.transform(lines, lambda x: x.startswith(CLOSES)), True)
    stamp = F.array_position(F.transform(lines, lambda x, i: is_stamp(x) & (i >= 4)), True) - 1
    end = F.when(closing > 0, F.when(stamp > 0, F.least(closing, stamp)).otherwise(closing)).when(stamp > 0, stamp).otherwise(F.size(lines))
    # records of a file are numbered, and the stamp after one carried to the next, in two levels: a log of any size is many tasks
    placed = scans.placed(found, ["path"], [F.col("place")], size=size)
    rows = scans.scanned(placed, ["path"], n=scans.Scan("sum", F.lit(1))).withColumn("lines", lines)
    rows = rows.withColumn("end", F.when(F.col("n") > 1, end).otherwise(0).cast("int"))
    rest = F.filter(F.slice("lines", F.col("end") + 1, F.greatest(F.size("lines"), F.lit(1))), is_stamp)
    told = F.regexp_extract(F.trim(F.try_element_at(rest, F.lit(-1))), STAMP, 1)
    rows = scans.scanned(rows.withColumn("_told", told), ["path"], _p=scans.previous(F.col("_told"))).withColumn("stamp", F.col("_p.v"))
    return rows.where("n > 1").select("path", (F.col("n") - 1).alias("message"), F.nullif("stamp", F.lit("")).alias("stamp"), "modified", F.slice("lines", F.lit(1), F.col("end")).alias("lines"))


def _number(tokens: str, k: int) -> Column:
    return F.get(tokens, F.lit(k)).try_cast("int").cast("double")


def parse(messages: DataFrame, unit: float = 1e-9, strict: bool = False) -> DataFrame:
    """Counts, scaled values, gate centres, flags and health of each message."""
    place = F.array_position(F.transform("lines", lambda x: F.trim(x).rlike(f"^[0-9A-Fa-f]{{{SHORTEST},}}$")), True)
    rows = messages.withColumn("at", place.cast("int")).where("at > 2")
    line = lambda k: F.trim(F.get("lines", k))
    rows = rows.withColumn("hex", line(F.col("at") - 1)).withColumn("status", line(F.lit(1)))
    rows = rows.withColumn("p", F.split(line(F.col("at") - 2), r"\s+")).withColumn("s", F.filter(F.split(F.substring("status", 3, 200), r"\s+"), lambda x: x != ""))
    for k, name in enumerate(FIELDS):
        rows = rows.withColumn(name, F.get("p", F.lit(k)) if name == "mode" else _number("p", k))
    room = F.floor(F.length("hex") / 5).cast("int")
    rows = rows.withColumn("n_gates", F.when((F.col("n_gates") > 0) & (F.col("n_gates") <= room), F.col("n_gates").cast("int")).otherwise(room))
    rows = rows.withColumn("resolution", F.when(F.col("resolution") > 0, F.col("resolution")).otherwise(10.0))
    rows = rows.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(100.0))
    rows = rows.withColumn("counts", fn.hex_profile("hex", F.col("n_gates")))
    body = F.concat(F.array_join(F.slice("lines", 1, F.col("at")), "\r\n"), F.lit("\r\n" + CLOSES))
    closing = F.get(F.filter(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda x: x.startswith(CLOSES)), F.lit(0))
    given = F.substring(closing, 2, 4)
    good = F.when(closing.isNotNull(), given.rlike("^[0-9A-Fa-f]{4}$") & (F.lower(given) == F.lower(F.lpad(F.hex(fn.crc16(body)), 4, "0"))))
    rows = rows.withColumn("crc_ok", good)
    digit, warning = F.substring("status", 1, 1), F.upper(F.substring("status", 2, 1))
    flag = lambda condition, name: F.when(condition, fn.QUALITY[name]).otherwise(0)
    quality = (
        flag(warning == "W", "instrument_warning")
        .bitwiseOR(flag(warning == "A", "instrument_alarm"))
        .bitwiseOR(flag(digit == "4", "fog"))
        .bitwiseOR(flag((digit == "/") | (F.lit(strict) & ~F.coalesce("crc_ok", F.lit(True))), "low_snr"))
        .bitwiseOR(flag(F.col("window") > 2000, "window_contaminated"))
        .bitwiseOR(flag(F.exists("counts", lambda c: F.coalesce(F.abs(c) >= FULL_SCALE, F.lit(False))), "saturated"))
    )
    bases = F.when(digit.rlike("[123]"), F.transform(F.slice("s", 1, F.coalesce(digit.try_cast("int"), F.lit(0))), lambda x: F.when(F.length(x) < 8, x.try_cast("double"))))
    return rows.select(
        "path",
        "message",
        F.unix_micros(F.try_to_timestamp(F.regexp_replace("stamp", "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("t"),
        "modified",
        F.transform("counts", lambda c: c * F.lit(unit) * (F.lit(100.0) / F.col("scale"))).alias("beta"),
        F.transform(F.sequence(F.lit(0), F.col("n_gates") - 1), lambda i: (i + 0.5) * F.col("resolution")).alias("r"),
        quality.cast("long").alias("quality"),
        bases.alias("cloud_base_reported"),
        F.when(digit.isin("4", "5"), F.get("s", F.lit(0)).try_cast("double")).alias("vertical_visibility"),
        F.when(digit.isin("4", "5"), F.get("s", F.lit(1)).try_cast("double")).alias("highest_signal"),
        F.when(F.try_element_at("s", F.lit(-1)).rlike("^[0-9A-Fa-f]{8}$"), F.try_element_at("s", F.lit(-1))).alias("alarm"),
        "crc_ok",
        F.lit(True).alias("range_corrected"),
        F.lit(True).alias("background_subtracted"),
        *[n for n in FIELDS if n not in ("scale", "n_gates", "resolution")],
    )


def fill_times(rows: DataFrame, interval: float = 30.0, start: int | None = None) -> DataFrame:
    """Messages without a time count on from the nearest message of their file that has one (the earlier of two), at the
    file's median cadence. In a file without any time they count from ``start`` (microseconds), or end when the file was
    last written."""
    w, file = Window.partitionBy("path").orderBy("message"), Window.partitionBy("path")
    known = F.when(F.col("t").isNotNull(), F.struct("message", "t"))
    rows = rows.withColumn("b", F.last(known, ignorenulls=True).over(w)).withColumn("a", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("p", before).withColumn("d", (F.col("t") - F.col("p.t")) / (F.col("message") - F.col("p.message")))
    rows = rows.withColumn("step", F.coalesce(F.percentile("d", F.lit(0.5)).over(file), F.lit(interval * 1e6)))
    after = F.col("b").isNull() | (F.col("a.message") - F.col("message") < F.col("message") - F.col("b.message"))
    opened = F.lit(start).cast("long") if start is not None else F.unix_micros("modified") - ((F.count("*").over(file) - 1) * interval * 1e6).cast("long")
    first = F.struct(F.min("message").over(file).alias("message"), opened.alias("t"))
    rows = rows.withColumn("n", F.coalesce(F.when(after, F.col("a")), F.col("b"), first))
    return rows.withColumn("t", F.coalesce("t", (F.col("n.t") + (F.col("message") - F.col("n.message")) * F.col("step")).cast("long"))).drop("a", "b", "p", "d", "n", "step", "modified")


def read(spark: SparkSession, paths: str | list[str], unit: float = 1e-9, interval: float = 30.0, start: int | None = None, strict: bool = False, glob: str | None = None) -> DataFrame:
    """Profiles of logs. unit: what a count stands for; interval and start: of messages without time stamps; strict: a
    message whose checksum fails is of low signal."""
    return fill_times(parse(split_messages(records(spark, paths, glob)), unit, strict), interval, start)


def write(profiles: DataFrame, path: str, unit: float = 1e-9, name: str = "CL010112") -> None:
    """Logs of messages, one file for each partition of time, from (t, beta, r) and, where they are given, digit, bases
    (heights), laser_temperature and background."""
    has = lambda c, other: F.coalesce(c, F.lit(other)) if c in profiles.columns else F.lit(other)
    count = lambda b: F.coalesce(F.rint(F.greatest(F.least(b / F.lit(unit), F.lit(float(FULL_SCALE))), F.lit(-float(FULL_SCALE) - 1))), F.lit(0.0)).cast("long")
    digits = F.array_join(F.transform("beta", lambda b: fn.hex_encode(count(b))), "")
    bases = F.coalesce("bases", F.array().cast("array<double>")) if "bases" in profiles.columns else F.array().cast("array<double>")
    digit = F.coalesce("digit", F.size(bases).cast("string")) if "digit" in profiles.columns else F.size(bases).cast("string")
    heights = F.array_join(F.transform(bases, lambda b: F.lpad(F.rint(b).cast("long").cast("string"), 5, "0")), " ")
    status = F.concat(digit, F.lit("0 "), heights, F.when(F.size(bases) > 0, " ").otherwise(""), F.lit("00000000"))
    apart = F.get("r", F.lit(1)) - F.get("r", F.lit(0))
    total = fn.array_sum("beta") * apart * 1e4
    params = F.format_string("00100 %02d %04d 099 %+03d 099 0000 L0112HN15 %03d %03d", F.rint(apart).cast("int"), F.size("beta"), has("laser_temperature", 25.0).cast("int"), has("background", 30.0).cast("int"), F.greatest(F.least(F.floor(total), F.lit(999)), F.lit(0)).cast("int"))
    body = F.concat(F.concat_ws("\r\n", F.lit(name), status, params, digits), F.lit("\r\n" + CLOSES))
    stamp = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm:ss")
    text = F.concat(F.lit("-"), stamp, F.lit("\r\n" + OPENS), body, F.lower(F.lpad(F.hex(fn.crc16(body)), 4, "0")), F.lit("\r\n\r"))
    profiles.select("t", text.alias("value")).repartitionByRange("t").sortWithinPartitions("t").select("value").write.text(path)
