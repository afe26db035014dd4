"""Gridded text: ``#`` lines of metadata, a header ``time,<range>,...``, then one row for each profile.

Every line is read on its own (files split and may be compressed). A file's header is its first line that is no metadata, and
its metadata are lines like others; both are found by an aggregate for each file and joined back, as their number grows with
the files alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The comment that files written here begin with.
MAGIC = "# gridded-profiles"


def _truth(key: str):
    return F.coalesce(F.lower(F.try_element_at("meta", F.lit(key))).isin("1", "true", "yes", "y", "on"), F.lit(False))


class FormatError(ValueError):
    """A file that is not what its reader takes."""


def read(spark: SparkSession, paths: str | list[str], scale: float = 1.0, glob: str | None = None) -> DataFrame:
    """path, t (microseconds), beta, r, range_corrected, background_subtracted, meta. Blank, bad and NaN cells are NULL;
    rows short of cells end in NULLs; times are seconds or ISO 8601, without zone UTC. A file without rows, or whose header
    is not a time and numbers, is an error."""
    reader = spark.read.option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(paths)
    meta = F.col("_metadata")
    lines = raw.select(meta["file_path"].alias("path"), F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"), F.rtrim("value").alias("line")).where("line != ''")
    pattern = r"^#\s*([^=:]+?)\s*[=:]\s*(.*)$"
    note = F.struct("place", F.lower(F.regexp_extract("line", pattern, 1)).alias("k"), F.regexp_extract("line", pattern, 2).alias("v"))
    is_note = F.col("line").startswith("#")
    told = F.array_sort(F.collect_list(F.when(is_note & F.col("line").rlike(pattern), note)))  # a file's few notes
    grid = lines.groupBy("path").agg(told.alias("notes"), F.min(F.when(~is_note, F.struct("place", "line"))).alias("h"), F.count_if(~is_note).alias("n"))
    latest = F.aggregate("notes", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _v: k != x["k"]), F.create_map(x["k"], x["v"])))
    ranges = F.transform(F.filter(F.split("h.line", ","), lambda _x, i: i > 0), lambda x: F.trim(x).try_cast("double"))
    grid = grid.select("path", "h.place", "n", ranges.alias("r"), latest.alias("meta"))
    wrong = grid.where((F.col("n") < 2) | F.exists("r", lambda x: x.isNull()) | (F.size("r") == 0)).select("path").first()
    if wrong is not None:
        raise FormatError(f"{wrong['path']}: no header of a time and numbers, or no rows below it")
    grid = grid.select(F.col("path").alias("_path"), F.col("place").alias("_place"), "r", _truth("range_corrected").alias("range_corrected"), _truth("background_subtracted").alias("background_subtracted"), "meta")
    rows = lines.where(~is_note).join(grid, (F.col("path") == F.col("_path")) & (F.col("place") != F.col("_place")))
    cells = F.split("line", ",")
    value = lambda x: F.when(~F.isnan(F.trim(x).try_cast("double")), F.trim(x).try_cast("double") * scale)
    stamp = F.trim(F.get(cells, F.lit(0)))
    t = F.coalesce((stamp.try_cast("double") * 1e6).cast("long"), F.unix_micros(F.try_to_timestamp(F.when(stamp.rlike("[Zz]$|[+-][0-9]{2}:?[0-9]{2}$"), stamp).otherwise(F.concat(stamp, F.lit("Z"))))))
    beta = F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: value(F.get(cells, i)))
    return rows.select("path", t.alias("t"), beta.alias("beta"), "r", "range_corrected", "background_subtracted", "meta").where("t IS NOT NULL")


def write(profiles: DataFrame, path: str, ranges: list[float], range_corrected: bool = False, background_subtracted: bool = False) -> None:
    """Parts of gridded text, each with its own header, so that every part can be read alone."""
    head = [f"{MAGIC} v1", f"# range_corrected = {str(range_corrected).lower()}", f"# background_subtracted = {str(background_subtracted).lower()}", "time," + ",".join(f"{r:g}" for r in ranges)]
    cells = F.array_join(F.transform("beta", lambda v: F.coalesce(F.format_string("%.6e", v), F.lit("nan"))), ",")
    line = F.concat(F.format_string("%.6f", F.col("t") / 1e6), F.lit(","), cells)
    rows = profiles.select("t", line.alias("value")).repartitionByRange("t").sortWithinPartitions("t").select("value")

    def headed(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    rows.mapInArrow(headed, "value string").write.text(path)
