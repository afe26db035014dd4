"""Joins of many rows to few facts, some of which a large share of the rows may want."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one row in so many wants is broadcast; there can be no more such keys than this.
SHARE = 1000


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], wanted: str, total: int, share: int = SHARE) -> DataFrame:
    """Each row with its key's fact, one for each key at most; NULLs where there is none. Column ``wanted`` of facts holds how many
    rows there are of its key and ``total`` how many rows in all. Facts that many rows want (fewer than ``share``, as each has more than
    total / share rows) are broadcast; the others are shuffled, and none of their keys has more rows than that. Keys that are NULL
    find nothing."""
    hot = facts.where(F.col(wanted) > total / share)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    few = marked.where("_hot").drop("_hot").join(F.broadcast(hot.drop(wanted)), keys)
    return few.unionByName(marked.where("_hot IS NULL").drop("_hot").join(facts.where(F.col(wanted) <= total / share).drop(wanted), keys, "left"))
