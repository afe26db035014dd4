"""Exact top-k by no-random-access aggregation.

A vector's score is a sum over components, so each component is a list sorted by value. The lists are read in
slabs, from the end that a query's sign favours: a slab's entries add to the sums of the vectors they belong to,
and a component of a vector that was not read yet lies between the list's frontier and its other end. This gives every
vector a lower and an upper bound. Reading goes on for the vectors whose upper bound reaches the k-th lower bound, and
stops for a query once these are few; what they lack is then read, which resolves their final scores.

Candidates stay where they are: a task takes its rows in blocks of BLOCK, sorts a block's lists, and keeps each query's k
best, whose last score bounds the next block. Queries come in blocks of at most QUERIES rows, SCANNED blocks to one broadcast and
one scan of the candidates, however many there are. First they meet one candidate in FIRST; the k-th score there is a floor for all
tasks, so that what tasks send grows with the queries alone. No candidate moves, and no pair of blocks is made.
Integers below 2**53 are exact in double arithmetic.

Cases: vectors that are null or hold null or non-finite components take no part; a missing component of a
shorter vector counts as 0; ties go to the smaller id; repeated rows are candidates each on their own (not for
a query of the same id) and queries each on their own, with k answers each; fewer than k candidates give all; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.cluster import settle

BLOCK, QUERIES, FIRST, SCANNED = 1024, 2048, 8, 16
#: Shares of each list read before the bounds are looked at.
DEPTHS = (0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375, 1.0)


def clean(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    x = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    good = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(good & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles as rows, short ones filled with 0."""
    offsets = column.offsets.to_numpy()
    flat, n = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(offsets[:-1] - offsets[0], n)] = flat
    return out


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, v) packed into (block), ids and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                m = matrix(part.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array([tk.pack(part.column("vec_id").to_numpy(zero_copy_only=False), np.array(m.shape), m.ravel())], pa.binary())], ["block"])

    return rows.mapInArrow(run, "block binary")


def opened(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, shape, flat = tk.unpack(block)
    return ids, flat.reshape(*shape)


def padded(m: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dims - m.shape[1])))


class Reading:
    """How far the sorted lists of one block of candidates are read for some queries, and what is known of scores."""

    def __init__(self, candidates: np.ndarray, queries: np.ndarray) -> None:
        self.c, self.n = candidates, len(candidates)
        order = np.argsort(candidates, axis=0, kind="stable")
        self.sorted = np.take_along_axis(candidates, order, axis=0)
        self.place = np.empty_like(order)  # of each entry, from below
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)
        self.up, self.down = np.maximum(queries, 0), np.minimum(queries, 0)
        self.sum, self.depth = np.zeros((len(queries), self.n)), 0

    def read(self, depth: int) -> None:
        """Reads every list up to ``depth`` entries: from above for positive components, from below for negative ones."""
        from_above = self.n - 1 - self.place
        for q, place in ((self.up, from_above), (self.down, self.place)):
            self.sum += q @ np.where((place >= self.depth) & (place < depth), self.c, 0.0).T
        self.depth = depth

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score each candidate may have."""
        if self.depth >= self.n:
            return self.sum, self.sum
        high, low = self.sorted[self.n - self.depth] if self.depth else self.sorted[-1], self.sorted[max(self.depth - 1, 0)]
        unread_up = (self.place < self.n - self.depth).astype(float).T
        unread_down = (self.place >= self.depth).astype(float).T
        most = (self.up * high) @ unread_up + (self.down * low) @ unread_down
        least = (self.up * self.sorted[0]) @ unread_up + (self.down * self.sorted[-1]) @ unread_down
        return self.sum + least, self.sum + most

    def keep(self, queries: np.ndarray, candidates: np.ndarray) -> None:
        """Goes on for these queries and candidates alone; the lists stay."""
        self.up, self.down, self.sum = self.up[queries], self.down[queries], self.sum[np.ix_(queries, candidates)]
        self.c, self.place = self.c[candidates], self.place[candidates]

    def rest(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Final scores of pairs: what was read, and their entries that were not."""
        place = self.place[c]
        unread = np.where(self.up[q] > 0, place < self.n - self.depth, place >= self.depth)
        return self.sum[q, c] + np.einsum("ij,ij->i", self.up[q] + self.down[q], np.where(unread, self.c[c], 0.0))


def nra(candidates: np.ndarray, ids: np.ndarray, query: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    """(query's place, candidate's id, score) of each query's k best in a block that reach its floor, and how much was read."""
    reading, out = Reading(candidates, query), []
    which, here, floor = np.arange(len(query)), np.arange(len(ids)), floor.copy()
    own = query_ids[:, None] == ids
    seen = {"pairs": float(own.size), "read": 0.0, "resolved": 0.0}
    for share in DEPTHS:
        depth = max(1, int(share * reading.n))
        seen["read"] += (depth - reading.depth) * len(which) * query.shape[1]
        reading.read(depth)
        least, most = reading.bounds()
        mine = own[np.ix_(which, here)]
        if len(here) > k:
            least = np.where(mine, -np.inf, least)
            floor[which] = np.maximum(floor[which], np.partition(least, len(here) - k, axis=1)[:, len(here) - k])
        alive = ~mine & (most >= floor[which, None])
        done = alive.sum(axis=1) <= 2 * k
        done |= share == DEPTHS[-1]
        q, c = np.nonzero(alive & done[:, None])
        if share < DEPTHS[-1]:
            seen["resolved"] += len(q)
        out.append((which[q], ids[here[c]], reading.rest(q, c)))
        left = np.flatnonzero(~done)
        if not len(left):
            break
        go = np.flatnonzero(alive[left].any(axis=0))
        reading.keep(left, go)
        which, here = which[left], here[go]
    return *(np.concatenate(x) for x in zip(*out, strict=True)), seen


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's k best: by score, ties to smaller ids."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def asked(rows: DataFrame, packed: list[tuple[bytes, np.ndarray]], k: int) -> DataFrame:
    """(query, query_id, vec_id, score): each task's k best of its rows for some blocks of queries, each from its floor on. query is a
    query's place among all of these blocks."""
    sent = rows.sparkSession.sparkContext.broadcast(packed)  # at most SCANNED blocks of QUERIES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = [(*opened(block), floor.copy()) for block, floor in sent.value]
        known = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(asking)
        for part in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            m, ids = matrix(part.column("v")), part.column("vec_id").to_numpy(zero_copy_only=False)
            for n, (query_ids, query, floor) in enumerate(asking):
                dims = max(m.shape[1], query.shape[1])
                *new, _ = nra(padded(m, dims), ids, padded(query, dims), query_ids, floor, k)
                q, found, score = (np.concatenate(x) for x in zip(known[n], new, strict=True))
                kept = best(q, found, score, k)
                known[n] = q, found, score = q[kept], found[kept], score[kept]
                full = np.flatnonzero(np.bincount(q, minlength=len(query_ids)) >= k)
                floor[full] = np.maximum(floor[full], score[np.searchsorted(q, full, "right") - 1])
        for n, (q, found, score) in enumerate(known):
            yield pa.RecordBatch.from_arrays([pa.array(q + n * QUERIES), pa.array(asking[n][0][q]), pa.array(found), pa.array(score.astype(np.int64))], ["query", "query_id", "vec_id", "score"])

    return rows.mapInArrow(tk.tidy(run), "query long, query_id long, vec_id long, score long")


def topk(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and rows (vec_id, v). A query that is repeated gets its answers as often."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    wanted = -(-queries.count() // QUERIES)
    packed = settle(blocks(queries.repartition(max(1, wanted)), QUERIES))
    found, held = [], []

    def scan() -> DataFrame:
        sizes = [len(opened(b)[0]) for b in held]
        first = asked(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(FIRST)) == 0), [(b, np.full(n, -np.inf)) for b, n in zip(held, sizes, strict=True)], k)
        last = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", "score")
        floor = np.full(len(held) * QUERIES, -np.inf)
        for r in last.collect():  # at most SCANNED * QUERIES rows
            floor[r["query"]] = r["score"]
        best_of = asked(rows, [(b, floor[j * QUERIES : j * QUERIES + n]) for j, (b, n) in enumerate(zip(held, sizes, strict=True))], k)
        ranked = best_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    for row in packed.toLocalIterator():  # a block at a time
        held.append(bytes(row["block"]))
        if len(held) == SCANNED:
            found.append(settle(scan()))
            held = []
    if held:
        found.append(scan())
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, found)


def op6_topk(spark, sf_dir: str) -> DataFrame:
    rows = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk(rows.where("vec_id % 100 = 0"), rows)


ORACLE = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
