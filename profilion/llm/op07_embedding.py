"""Embedding near-dedup: an exact range join in a metric space.

On unit vectors, cosine >= c is distance <= r = sqrt(2 - 2c). Pivots partition the vectors: each lies in the
cell of its nearest pivot. By the triangle inequality it can only have a partner in another cell if it lies
within r of the plane between the two pivots, so it is replicated to just those cells; then each cell joins
on its own: every vector at home in it against all that it holds. A cell with more than HOME vectors at home
is split, and each part meets all that the cell holds, in blocks; no task holds more than one part.

How many pivots there are is chosen on a sample, from as many as fill cells of HOME rows up to PIVOTS: more of them make
smaller cells, but send more copies where the bound does not cut. With data as spread out as random directions it cuts
next to nothing at any number; then the fewest are taken, and the work is that of a blocked product of all vectors, which
grows with the square of the rows. Where vectors have a pivot close by, cells join almost alone. The result is exact always.

A block of pairs is one matrix product in single precision; pairs within EDGE of the limit are computed again
in double precision. A part keeps a union-find of what is at home in it, and tells each vector's number of links, one
link for each vector that it met and linked, and its forest: never the pairs, so that large groups stay linear in size
up to HOME vectors of a group, and beyond that grow with the number of parts.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing and are their own
component; shorter vectors are filled with 0; equal vectors are joined once and counted by their number;
rows of one id are rows of their own, whether their vectors are equal or not, and each has the links of its vector; extra
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.cluster import components, parts, settle
from profilion.llm.op06_topk import matrix
from profilion.operators import facts

PIVOTS, HOME, BLOCK, EDGE = 4096, 8192, 1024, 1e-4
#: Rows to choose the number of pivots on; pairs that cost as much as a vector sent; parts of the rows of equal vectors.
SAMPLE, SENT, SALT = 2048, 400, 8


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): x in doubles, null where a vector takes no part."""
    x = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("x"))  # -0 becomes 0
    good = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    return x.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), F.col("x")).alias("x"))


def name(x: str = "x") -> list:
    """Two hashes, 128 bits, that stand for a vector."""
    return [F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(7)).alias("h2")]


def classes(rows: DataFrame) -> DataFrame:
    """(vec_id, many, x): one row for each different vector that can link, with its smallest id."""
    return rows.where("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("many"))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spread(m: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's home, and whether a partner within r may be at home in each cell."""
    near = m @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    plane = near[np.arange(len(m)), home][:, None] - near  # (|v-p'|^2 - |v-p|^2) / 2
    return home, plane <= r * apart + 1e-9


def choose(sample: np.ndarray, n: int, r: float) -> np.ndarray:
    """As many pivots of the sample as make n rows cheapest to join."""
    fewest = min(max(1, -(-n // HOME)), PIVOTS, len(sample))
    counts = [k for k in (fewest << (2 * i) for i in range(12)) if k == fewest or k <= min(PIVOTS, len(sample) // 2)]
    probes = sample[-SAMPLE:]
    reach = [spread(probes, sample[:k], r)[1].sum(axis=1).mean() for k in counts]
    return sample[: counts[int(np.argmin([a * (n / k + SENT) for a, k in zip(reach, counts, strict=True)]))]]


class Part:
    """The vectors at home in one part of a cell, their links so far and a union-find of them."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.ids, many, self.m = (np.concatenate(x) for x in zip(*blocks, strict=True))
        self.narrow, self.links, self.root = self.m.astype(np.float32), many - 1, np.arange(len(self.ids))

    def meet(self, ids: np.ndarray, many: np.ndarray, g: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Joins a block of guests; returns one link (guest, own) for each guest that has any."""
        none = len(self.ids)
        g32, label, first = g.astype(np.float32).T, np.full(len(ids), none), np.full(len(ids), none)
        for lo in range(0, len(self.ids), BLOCK):
            s = self.narrow[lo : lo + BLOCK] @ g32
            i, j = np.nonzero(s > cosine - EDGE)
            sure = s[i, j] > cosine + EDGE
            sure[~sure] = np.einsum("ij,ij->i", self.m[lo + i[~sure]], g[j[~sure]]) >= cosine
            i, j = i[sure] + lo, j[sure]
            other = self.ids[i] != ids[j]
            i, j = i[other], j[other]
            self.links += np.bincount(i, many[j], none).astype(np.int64)
            np.minimum.at(first, j, i)
            while len(i):  # a guest's links are one component, with those it had before
                low = label.copy()
                np.minimum.at(low, j, self.root[i])
                before = self.root.copy()
                np.minimum.at(self.root, self.root[i], low[j])
                had = np.flatnonzero(label < none)
                np.minimum.at(self.root, label[had], low[had])
                while not np.array_equal(self.root, self.root[self.root]):
                    self.root = self.root[self.root]
                label = np.where(low < none, self.root[np.minimum(low, none - 1)], none)
                if np.array_equal(before, self.root):
                    break
        guest = np.flatnonzero(first < none)
        return ids[guest], self.ids[first[guest]]


def range_join(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(a, b, n) of rows (vec_id, many, x) with an id each: for b null, n is how many vectors a links with; else a link a, b, of a forest
    of all."""
    spark, r = rows.sparkSession, float(np.sqrt(2 - 2 * cosine))
    few = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    dims, n = few["dims"] or 1, few["n"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * PIVOTS + SAMPLE).select("x").collect()
    sample = np.array([row["x"] + [0.0] * (dims - len(row["x"])) for row in sample]).reshape(-1, dims)
    pivots = choose(unit(sample), n, r) if len(sample) else np.eye(1, dims)

    def of(b: pa.RecordBatch) -> np.ndarray:
        m = matrix(b.column("x"))
        return np.pad(m, ((0, 0), (0, dims - m.shape[1])))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for b in sliced(batches):
            total += np.bincount((unit(of(b)) @ pivots.T).argmax(axis=1), minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(total)], ["cell", "n"])

    home_counts = {x["cell"]: x["n"] for x in rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    split = np.array([max(1, -(-home_counts.get(c, 0) // HOME)) for c in range(len(pivots))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            m, ids, many = of(b), b.column("vec_id").to_numpy(), b.column("many").to_numpy()
            narrow = m.astype(np.float32)
            m_sent = narrow if np.array_equal(narrow, m) else m
            home, near = spread(unit(m), pivots, r)
            part = (tk.mix(ids.astype(tk.U)) >> tk.U(1)).astype(np.int64) % split[home]
            for cell in np.flatnonzero(near.any(axis=0)):
                guests, out = np.flatnonzero(near[:, cell]), []
                blob = tk.pack(ids[guests], many[guests], m_sent[guests].ravel())
                for p in range(split[cell]):
                    out.append((p, 1, blob))
                    own = np.flatnonzero((home == cell) & (part == p))
                    if len(own):
                        out.append((p, 0, tk.pack(ids[own], many[own], m_sent[own].ravel())))
                yield pa.RecordBatch.from_arrays([pa.array([int(cell)] * len(out)), *[pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], pa.array([x[2] for x in out], pa.binary())], ["cell", "part", "guest", "block"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, part = None, [], None

        def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, many, flat = tk.unpack(blob)
            return ids, many, unit(flat.reshape(len(ids), dims).astype(float))

        def told(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
            nothing = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), nothing if b is None else pa.array(b), nothing if n is None else pa.array(n)], ["a", "b", "n"])

        def closed() -> Iterator[pa.RecordBatch]:
            if part is not None:
                yield told(part.ids, None, part.links)
                other = part.root != np.arange(len(part.root))
                yield told(part.ids[other], part.ids[part.root[other]], None)

        for b in batches:
            for cell, p, guest, blob in zip(*(b.column(k).to_pylist() for k in ("cell", "part", "guest", "block")), strict=True):
                if key != (cell, p):
                    yield from closed()
                    key, own, part = (cell, p), [], None
                if not guest:
                    own.append(opened(blob))
                    continue
                if part is None and own:
                    part, own = Part(own), []
                if part is not None:
                    yield told(*part.meet(*opened(blob), cosine), None)
        yield from closed()

    dealt = rows.mapInArrow(tk.tidy(deal), "cell long, part long, guest long, block binary")
    met = dealt.repartition(parts(spark), "cell", "part").sortWithinPartitions("cell", "part", "guest")
    return met.mapInArrow(tk.tidy(join), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    rows = prepared(vectors)
    # each different vector has a number, as ids may be shared: read from a settled table it is the same each time
    one = settle(classes(rows)).withColumn("number", F.monotonically_increasing_id())
    found = settle(range_join(one.select(F.col("number").alias("vec_id"), "many", "x"), cosine))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("n"))
    linked = settle(components(found.where("b IS NOT NULL").select("a", "b")))
    # a component's name is its smallest id
    least = linked.join(one.select(F.col("number").alias("node"), "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("least"), F.count("*").alias("wanted"))
    linked = facts.joined(linked, settle(least), ["component"], "wanted", linked.count()).select(F.col("node").alias("number"), F.col("least").alias("component"))
    known = one.select("number", "vec_id", "many", *name()).join(counted, "number", "left").join(linked, "number", "left")
    # rows of equal vectors are dealt SALT ways; a vector that occurs once knows which way its row goes
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).cast("int")
    ways = F.when(F.col("many") > 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(salt))
    known = known.select("h1", "h2", F.explode(ways).alias("salt"), "n", F.coalesce("component", "vec_id").alias("component"))
    looked = rows.where("x IS NOT NULL").select("vec_id", *name(), salt.alias("salt")).join(known, ["h1", "h2", "salt"]).select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return looked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
