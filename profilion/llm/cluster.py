"""Session helpers: partition counts, filters, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from profilion.session import settle, written

__all__ = ["components", "key_filter", "may_hold", "parts", "settle", "with_columns", "written"]


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle makes here."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Least and most bits of a filter that stands for a set of keys, as powers of two: 128 KB to 32 MB.
FILTER_BITS = (20, 28)


def key_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter for a stored column of 64-bit hashes, two probes each, made in the cluster: eight bits or more for a
    key up to 2**25 keys, and never above 32 MB.

    What it lets through that is no key costs time only, so users must not rely on it to exclude."""
    h, bits = F.col(column), min(max(FILTER_BITS[0], (8 * hashes.count()).bit_length()), FILTER_BITS[1])
    at = hashes.select(F.explode(F.array(h.bitwiseAND(2**bits - 1), F.shiftrightunsigned(h, 64 - bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))").alias("bits"))
    out = np.zeros(2**bits // 64, np.uint64)
    got = words.toPandas()  # at most 2**FILTER_BITS[1] / 64 rows
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether keys of these 64-bit hashes may be in a filter."""
    found, bits = np.ones(len(hashes), bool), (len(filled) * 64).bit_length() - 1
    for at in (hashes & np.uint64(2**bits - 1), hashes >> np.uint64(64 - bits)):
        found &= (filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def with_columns(schema: StructType, **more: str) -> StructType:
    """A schema with columns added; one of the same name is replaced."""
    return StructType([f for f in schema.fields if f.name not in more] + [StructField(k, _parse_datatype_string(v)) for k, v in more.items()])


def _forest(frames):
    """A spanning forest of the links that one task sees: fewer links, same components."""
    for frame in frames:
        a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
        names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(names))
        u, v = flat[: len(a)], flat[len(a) :]
        while True:  # smallest label over links, then over pointers, till nothing changes
            before = root.copy()
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            np.minimum.at(root, before, root)
            root = root[root]
            if np.array_equal(before, root):
                break
        other = root != np.arange(len(names))
        yield pd.DataFrame({"a": names[other], "b": names[root[other]]})


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that links reach.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) on links in the cluster; each
    round is checkpointed, and only a count of changes comes to the driver. A star's centre may have any
    number of links, as both steps are an aggregate and a join, and never list a node's neighbours.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(pairs.distinct().mapInPandas(_forest, "a long, b long").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = settle(small.select("e.a", "e.b").where("a <> b").distinct())
        roots = after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        many = after.groupBy("a").count().where("count > 1")
        done = roots.isEmpty() and many.isEmpty()
        edges = after
        if done:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
