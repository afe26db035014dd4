"""Profiles, layers and facts kept in Parquet by epoch-aligned buckets of time, for as long as the retention says.

A write replaces exactly the span of time that it brings, of the sites that it brings, and keeps all else in the buckets it
touches; so buckets may arrive in pieces, in any order and again. Every bucket inside the span is rewritten, also one that
is left empty. Rows that are kept are read from a checkpoint, so that a lost executor never finds a bucket half replaced.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profilion.functions import profiles as fn
from profilion.operators import aggregates, facts
from profilion.session import settle

HOUR = 3_600_000_000
#: Rows of a file: some hundred MB of profiles.
FILE_ROWS = 50_000


#: What columns hold, written with every file: units, a name and, where one is needed, a caveat.
ATTRIBUTES = {
    "t": {"units": "microseconds since 1970-01-01 UTC", "long_name": "time of the profile"},
    "r": {"units": "m", "long_name": "distance of gate centres from the instrument", "comment": "along the beam: a height above ground only where it points to the zenith"},
    "beta": {"units": "m-1 sr-1", "long_name": "attenuated backscatter"},
    "beta_smooth": {"units": "m-1 sr-1", "long_name": "attenuated backscatter, box mean of unscreened gates"},
    "sigma_smooth": {"units": "m-1 sr-1", "long_name": "standard error of the box mean"},
    "quality": {"units": "1", "long_name": "quality bits"},
    "base": {"units": "m", "long_name": "lower edge of the layer", "comment": "above the instrument, not above sea level"},
    "top": {"units": "m", "long_name": "upper edge of the layer", "comment": "above the instrument, not above sea level"},
    "confidence": {"units": "1", "long_name": "how sure the layer is, 0 to 1"},
}


class Table:
    """A folder of rows with a column t (microseconds). keys: columns that are unique together, t among them; None: no row
    replaces another of one write. A span is replaced for each ``of`` (such as site) alone."""

    def __init__(self, spark: SparkSession, path: str, width: int, keys: list[str] | None = None, of: list[str] | None = None) -> None:
        self.spark, self.path, self.width, self.keys, self.of = spark, path, width, keys, of or []

    def folder(self, below: str = ""):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + below)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame | None:
        """All that is stored, with its bucket; None before the first write and after all is purged."""
        folder, files = self.folder()
        if not files.exists(folder) or not any(x.getPath().getName().startswith("bucket=") for x in files.listStatus(folder)):
            return None
        return self.spark.read.parquet(self.path)

    def spans(self, new: DataFrame) -> DataFrame:
        return new.groupBy(*self.of).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))

    def write(self, new: DataFrame, order: list[Column] | None = None, spans: DataFrame | None = None) -> None:
        """Replaces what is stored between the first and the last time of ``new``. Of rows with equal keys the first in
        ``order`` stays (by default, of all other columns). spans: what to replace instead, (of..., _lo, _hi)."""
        if self.keys:
            by = order or [F.col(c) for c in new.columns if c not in self.keys and not new.schema[c].dataType.typeName() == "map"]
            new = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(by or [F.lit(0)])))).where("_rank = 1").drop("_rank")
        new = settle(new.withColumn("bucket", F.floor(F.col("t") / self.width) * self.width))
        spans = settle(self.spans(new) if spans is None else spans)
        span = spans.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).first()
        if span.lo is None:
            return
        stored, emptied = self.rows(), []
        if stored is not None:
            touched = stored.where(F.col("bucket").between(span.lo // self.width * self.width, span.hi // self.width * self.width))
            inside = F.col("t").between(F.col("_lo"), F.col("_hi"))
            for k in self.of:
                inside = inside & touched[k].eqNullSafe(spans[k])
            new = settle(touched.join(spans, inside, "left_anti").unionByName(new, allowMissingColumns=True))
            old, left = ({r["bucket"] for r in x.select("bucket").distinct().collect()} for x in (touched, new))  # a few for each day
            emptied = sorted(old - left)
        self.replace(new)
        self.drop(emptied)

    def replace(self, rows: DataFrame) -> None:
        """Overwrites the buckets of settled rows, each in as many files as its rows fill."""
        sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))  # a row for each bucket, a few for each day
        total = sizes.agg(F.sum("_files")).first()[0] or 1
        dealt = rows.join(F.broadcast(sizes), "bucket").withColumn("_deal", F.pmod(F.xxhash64("t"), F.col("_files"))).drop("_files")
        out = dealt.repartition(int(total), "bucket", "_deal").sortWithinPartitions("bucket", "t").drop("_deal")
        for name, told in self.described(rows).items():
            out = out.withMetadata(name, told)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def merge(self, new: DataFrame, order: list[Column] | None = None) -> None:
        """Adds rows to their buckets; of rows with equal keys, stored or new, the first in ``order`` stays (by default, of all other
        columns). So rows may come in any order, in any pieces, and again: what is stored in the end is the same."""
        by = order or [F.col(c) for c in new.columns if c not in self.keys and new.schema[c].dataType.typeName() != "map"]
        new = settle(new.withColumn("bucket", F.floor(F.col("t") / self.width) * self.width))
        stored = self.rows()
        if stored is not None:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # a few for each day
            new = new.unionByName(stored.where(F.col("bucket").isin(touched)), allowMissingColumns=True)
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(by or [F.lit(0)])))
        new = settle(new.withColumn("_rank", rank).where("_rank = 1").drop("_rank"))
        if not new.isEmpty():
            self.replace(new)

    def described(self, rows: DataFrame) -> dict[str, dict]:
        """Attributes of columns: what rows say of theirs, else what is stored, else ATTRIBUTES."""
        stored = self.rows()
        before = {} if stored is None else {f.name: f.metadata for f in stored.schema.fields}
        told = {f.name: f.metadata or before.get(f.name) or ATTRIBUTES.get(f.name) for f in rows.schema.fields}
        return {name: {str(k): v for k, v in m.items()} for name, m in told.items() if m}

    def attributes(self) -> dict[str, dict]:
        """Attributes of the stored columns, as the files tell them."""
        rows = self.rows()
        return {} if rows is None else {f.name: dict(f.metadata) for f in rows.schema.fields if f.metadata}

    def drop(self, buckets: list[int]) -> None:
        for bucket in buckets:
            folder, files = self.folder(f"/bucket={bucket}")
            files.delete(folder, True)

    def window(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Rows from lo to hi, both included. Whole buckets are pruned."""
        rows = self.rows()
        if rows is None:
            raise ValueError(f"nothing stored in {self.path}")
        if lo is not None:
            rows = rows.where((F.col("bucket") >= lo // self.width * self.width) & (F.col("t") >= lo))
        if hi is not None:
            rows = rows.where((F.col("bucket") <= hi) & (F.col("t") <= hi))
        return rows.drop("bucket")

    def purge(self, cutoff: int) -> int:
        """Deletes rows before cutoff; returns how many buckets went as a whole."""
        rows = self.rows()
        if rows is None:
            return 0
        spans = rows.groupBy("bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where(F.col("lo") < cutoff).collect()  # a few for each day
        self.drop([r.bucket for r in spans if r.hi < cutoff])
        parts = [r.bucket for r in spans if r.hi >= cutoff]
        if parts:
            self.replace(settle(rows.where(F.col("bucket").isin(parts) & (F.col("t") >= cutoff))))
        return len(spans) - len(parts)


class Store:
    """Profiles (site, t, ...), layers (site, t, type, base, top, confidence, track, interpolated, ...) and facts."""

    def __init__(self, spark: SparkSession, path: str, bucket_hours: float = 6, retention_hours: float = 72, keys: list[str] | None = None) -> None:
        """keys: what is unique among profiles, with t; by default (site, t), or t where profiles have no site."""
        self.spark, self.path, self.keys = spark, path, keys
        self.width, self.keep = max(int(bucket_hours * HOUR), HOUR // 60), int(retention_hours * HOUR)
        self.layer_table = Table(spark, f"{path}/layers", self.width, None, ["site"])

    def table(self, columns: list[str]) -> Table:
        keys = self.keys or [c for c in ("site", "t") if c in columns]
        return Table(self.spark, f"{self.path}/profiles", self.width, keys, [k for k in keys if k != "t"])

    @property
    def profiles(self) -> Table:
        return self.table(["t"])

    def rows(self) -> DataFrame | None:
        return self.profiles.rows()

    def write(self, profiles: DataFrame, layers: DataFrame | None = None, order: list[Column] | None = None, **facts) -> dict:
        """Stores profiles, the layers of the same span and facts, then purges what is older than the retention."""
        table = self.table(profiles.columns)
        profiles = settle(profiles)
        spans = table.spans(profiles)
        count = profiles.count()
        if not count:
            return {"profiles": 0, "layers": 0, "purged": 0}
        table.write(profiles, order)
        many = 0
        if layers is not None:
            layers = settle(layers)
            many = layers.count()
            self.layer_table.write(layers, spans=spans)
        self.set_facts(**facts, last_write=time.time())
        return {"profiles": count, "layers": many, "purged": self.purge()}

    # -- facts

    def facts(self) -> dict:
        """Key and value of all that was set; values are JSON."""
        folder, files = self.profiles.folder()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "/facts.json")
        if not files.exists(place):
            return {}
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def set_facts(self, **values) -> None:
        """Adds to the facts or replaces them; None removes one. Numpy scalars become plain numbers."""
        plain = {k: v.item() if hasattr(v, "item") else v for k, v in values.items()}
        facts = {k: v for k, v in (self.facts() | plain).items() if v is not None}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "/facts.json")
        stream = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True)
        stream.write(bytearray(json.dumps(facts).encode()))
        stream.close()

    # -- reading

    def of_site(self, rows: DataFrame, site) -> DataFrame:
        """Rows of a site; of all, if none is asked for."""
        return rows if site is None else rows.where(F.col("site") == F.lit(site))

    def latest(self, site=None) -> int | None:
        """The latest time stored, of a site or of all. Footers of the last buckets tell it."""
        rows = self.rows()
        return None if rows is None else self.of_site(rows, site).agg(F.max("t")).first()[0]

    def sites(self) -> list:
        """The sites that profiles are stored of, in order: a few for a store."""
        rows = self.rows()
        return [] if rows is None or "site" not in rows.columns else [r["site"] for r in rows.select("site").distinct().orderBy("site").collect()]

    def span(self) -> tuple[int | None, int | None]:
        rows = self.rows()
        return (None, None) if rows is None else tuple(rows.agg(F.min("t"), F.max("t")).first())

    def _bounds(self, lo: int | None, hi: int | None, hours: float | None, site=None) -> tuple[int | None, int | None]:
        if hours is not None:
            hi = self.latest(site) if hi is None else hi
            lo = None if hi is None else hi - int(hours * HOUR)
        return lo, hi

    def window(self, lo: int | None = None, hi: int | None = None, hours: float | None = None, max_height: float | None = None, site=None) -> DataFrame:
        """Profiles of a site or of all from lo to hi, or of the last hours up to hi or its latest row; arrays of gates up to a height."""
        rows = self.of_site(self.profiles.window(*self._bounds(lo, hi, hours, site)), site)
        if max_height is not None:
            gates = F.size(F.filter("r", lambda h: h <= max_height))
            arrays = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array" and f.name not in ("cloud_base_reported", "r")]
            rows = rows.withColumns({c: F.slice(c, F.lit(1), gates) for c in [*arrays, "r"]})
        return rows

    def layers(self, lo: int | None = None, hi: int | None = None, hours: float | None = None, types: list[str] | None = None, least: float = 0.0, interpolated: bool = True, site=None) -> DataFrame:
        """Layers of a site or of all, in order of time and base. least: leaves out those less sure, and if it is above 0 those of no
        known confidence."""
        rows = self.of_site(self.layer_table.window(*self._bounds(lo, hi, hours, site)), site)
        rows = rows.where(F.col("confidence") >= least) if least > 0 else rows
        rows = rows.where(F.col("type").isin(types)) if types else rows
        return (rows if interpolated else rows.where(~F.col("interpolated"))).orderBy("t", "base", "type")

    def latest_profile(self, site=None) -> dict | None:
        """A site's latest profile at full resolution, with its flags and the layers half a second around it; without a site, that of the
        first site in order among those of the latest time."""
        t = self.latest(site)
        if t is None:
            return None
        rows = self.window(t, t, site=site).withColumn("flags", fn.flag_names("quality")).withColumn("screened", fn.screened("quality"))
        row = (rows.orderBy("site") if "site" in rows.columns else rows).first().asDict(recursive=True)
        near = [] if self.layer_table.rows() is None else [r.asDict(recursive=True) for r in self.layers(t - 500_000, t + 500_000, site=row.get("site")).collect()]  # one profile's layers
        return row | {"layers": [x for x in near if x.get("site") == row.get("site")]}

    def catalogue(self) -> DataFrame:
        """First and last time and rows of every bucket."""
        return aggregates.spans(self.rows(), ["bucket"], "t")

    def grids(self) -> DataFrame:
        """The grids of profiles there are: gates, lowest and highest, first and last time."""
        return self.rows().groupBy(F.size("r").alias("gates"), F.get("r", F.lit(0)).alias("lowest"), F.array_max("r").alias("highest")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))

    def status(self) -> dict:
        """Span, hours, files and bytes stored, retention, and the facts."""
        lo, hi = self.span()
        folder, files = self.profiles.folder()
        size = files.getContentSummary(folder) if files.exists(folder) else None
        return self.facts() | {"first_t": lo, "last_t": hi, "hours": (hi - lo) / HOUR if lo is not None else 0.0, "files": size.getFileCount() if size else 0, "bytes": size.getLength() if size else 0, "retention_hours": self.keep / HOUR}

    def retained(self) -> DataFrame:
        """Rows within the retention, counted back from the latest row, by which readers see no older ones."""
        return self.window(hours=self.keep / HOUR)

    def purge(self) -> int:
        """Deletes what is older than the retention; returns how many buckets of profiles went."""
        latest = self.latest()
        if latest is None:
            return 0
        self.layer_table.purge(latest - self.keep)
        return self.profiles.purge(latest - self.keep)

    def delete(self, buckets: list[int]) -> None:
        """Drops buckets of profiles and layers."""
        for table in (self.profiles, self.layer_table):
            table.drop(buckets)


def compatible(profiles: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Profiles on the grid of the first one, or of the first of their keys, such as the site; those of another grid cannot be stacked on
    it and are left out."""
    if keys:
        grids = profiles.groupBy(*keys).agg(F.min_by("r", "t").alias("_r"), F.count("*").alias("_many"))
        stacked = facts.joined(profiles, settle(grids), keys, "_many", profiles.count())
        return stacked.where((F.size("r") == F.size("_r")) & _near("_r")).drop("_r")
    first = profiles.agg(F.min_by("r", "t").alias("_r"))
    return profiles.join(F.broadcast(first), (F.size("r") == F.size("_r")) & _near("_r")).drop("_r")  # one row


def _near(grid: str) -> Column:
    return F.forall(F.arrays_zip(F.col("r").alias("a"), F.col(grid).alias("b")), lambda x: F.coalesce(F.abs(x["a"] - x["b"]) <= F.abs(x["b"]) * 1e-5 + 1e-8, F.lit(False)))


def union(blocks: list[DataFrame]) -> DataFrame:
    """All rows of several blocks, in no order; columns that one has not got are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
