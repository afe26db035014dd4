"""LM scoring: a bigram model by deleted interpolation.

P(w | v) = a(b) c(v,w)/c(v) + u(b) c(w)/N + z(b)/(V+1), where b is the bucket of how often the context v
occurs (powers of two). The mixture weights of each bucket are learnt by expectation-maximisation on held-out
counts: every training token is left out of the counts in turn. The end token closes every text and is also
the context of the next one's first word.

Counts are exact 64-bit sums and cover all training texts. The table is scanned once, into compressed groups of
about GROUP bytes of text, which are written; all later steps read these. For each range of hashes a group sends
its sorted distinct words and word pairs (64-bit fingerprints) with their counts. A range adds up what came, and
replies to each group with the totals in the same order. The group's texts meet the replies, so each token knows
c(v,w), c(v) and c(w). There are as many ranges as groups, so that a range holds about as much as a group.
A histogram of the counts, of bounded size, is all that comes to the driver; learning from its bins (quarters of
a power of two, each with its own mean) instead of from single tokens moves a weight by less than 0.02 and a
score by less than 0.002 for each token on the tests' texts, against expectation-maximisation token by token.

Cases: null counts as empty, an empty text is one end token; without training rows N and V are 0 and all
scores come from the uniform part; a null held_out is a training row; repeated rows count and are scored each on
their own; ties do not occur; texts of any length stay whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.cluster import parts, settle

GROUP = 16 << 20
END = np.uint64(0x5851F42D4C957F2D)
BUCKETS, BINS = 64, 127
WORDS, PAIRS, TEXTS, TOTAL = 0, 1, 2, 3


def stored(docs: DataFrame) -> DataFrame:
    """(group, blob): the texts, ids and held_out of about GROUP bytes each, compressed and written."""

    def packed(held: list[tk.Chunk]) -> pa.RecordBatch:
        flag = lambda c, of: of(c.rows).to_numpy(zero_copy_only=False).astype(np.uint8)
        join = lambda f: np.concatenate([f(c) for c in held])
        blob = tk.pack(join(lambda c: c.ids("doc_id")), join(lambda c: flag(c, lambda r: r.column("doc_id").is_null())), join(lambda c: flag(c, lambda r: r.column("held_out"))), join(lambda c: c.hi - c.lo), np.array([len(c.lo) for c in held]), *[c.data for c in held])
        return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for c in tk.chunks(batches):
            held.append(c)
            size += len(c.data)
            if size >= GROUP:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return settle(docs.mapInArrow(tk.tidy(run), "blob binary").withColumn("group", F.monotonically_increasing_id()))


def read_group(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, which of them are null, held_out, words with end tokens, and tokens for each text."""
    ids, null, held, size, rows, *data = tk.unpack(blob)
    each, at = [], 0
    for d, k in zip(data, rows, strict=True):
        hi = np.cumsum(size[at : at + k] + 1) - 1
        each.append(tokens(*tk.word_hashes(tk.Chunk(None, d, hi - size[at : at + k], hi))))
        at += k
    w, n = (np.concatenate(x) for x in zip(*each, strict=True))
    return ids, null, held, w, n


def tokens(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints with an end token after each text, and how many tokens each text has."""
    return np.insert(words, first[1:], END), np.diff(first) + 1


def pairs(w: np.ndarray) -> np.ndarray:
    """Fingerprints of each token with the one before it; texts open after an end token."""
    before = np.concatenate([[END], w[:-1]]) if len(w) else w
    return tk.mix(before * tk.U(3) + tk.mix(w))


def cuts(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of sorted fingerprints begins, and the end."""
    edges = [k * 2**64 // ranges for k in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, tk.U)), [len(values)]]).astype(int)


def requests(texts: DataFrame, ranges: int) -> DataFrame:
    """(kind, range, group, blob): each group's sorted fingerprints and training counts by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, blob in zip(b.column("group").to_pylist(), b.column("blob").to_pylist(), strict=True):
                _, _, held, w, n = read_group(blob)
                train = np.repeat(held == 0, n)
                for kind, values in ((WORDS, w), (PAIRS, pairs(w))):
                    distinct, place = np.unique(values, return_inverse=True)
                    counts = np.bincount(place, train, len(distinct)).astype(np.uint64)
                    at = cuts(distinct, ranges)
                    out = [(r, tk.pack(tk.deltas(distinct[x:y]), counts[x:y])) for r, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([key] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["kind", "range", "group", "blob"])

    return texts.select("group", "blob").mapInArrow(tk.tidy(run), "kind long, range long, group long, blob binary")


def added_up(blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """The totals in each request's order, all their sum, and how many are above 0."""
    got = [tk.unpack(x) for x in blobs]
    values, place = np.unique(np.concatenate([np.cumsum(x[0]) for x in got]), return_inverse=True)
    total = np.zeros(len(values), np.uint64)
    np.add.at(total, place, np.concatenate([x[1] for x in got]))
    ends = np.cumsum([len(x[0]) for x in got])
    return [tk.pack(part) for part in np.split(total[place], ends[:-1])], int(total.sum()), int((total > 0).sum())


def replies(asked: DataFrame) -> DataFrame:
    """(kind, range, group, blob, n, v): the totals, in each request's order; also rows of a range's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who, blobs = None, [], []

        def answer() -> pa.RecordBatch:
            sent, n, v = added_up(blobs)
            k, r = now
            columns = [[k] * len(who) + [TOTAL], [r] * len(who) + [k], [*who, -1 - r], [*sent, b""], [None] * len(who) + [n], [None] * len(who) + [v]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["kind", "range", "group", "blob", "n", "v"])

        for b in batches:
            for kind, r, group, blob in zip(*(b.column(k).to_pylist() for k in ("kind", "range", "group", "blob")), strict=True):
                if (kind, r) != now:
                    if who:
                        yield answer()
                    now, who, blobs = (kind, r), [], []
                who.append(group)
                blobs.append(blob)
        if who:
            yield answer()

    met = asked.repartition(parts(asked.sparkSession), "kind", "range").sortWithinPartitions("kind", "range", "group")
    return met.mapInArrow(tk.tidy(run), "kind long, range long, group long, blob binary, n long, v long")


def counted(texts: DataFrame, answered: DataFrame) -> DataFrame:
    """One row for each group: its documents, and for each token its counts, packed; sums pass by (n, v, and no blob)."""
    schema = pa.schema([("blob", pa.binary()), ("kind", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heard = None, {}
        for b in batches:
            for kind, r, group, blob, n_sum, v_sum in zip(*(b.column(k).to_pylist() for k in ("kind", "range", "group", "blob", "n", "v")), strict=True):
                if kind == TOTAL:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([None], [r], [n_sum], [v_sum]), schema.types, strict=True)], schema=schema)
                    continue
                if group != now:
                    now, heard = group, {}
                if kind != TEXTS:
                    heard[kind, r] = blob
                    continue
                ids, null, held, w, n = read_group(blob)
                total = {what: np.concatenate([tk.unpack(heard[key])[0] for key in sorted(heard) if key[0] == what]) for what in (WORDS, PAIRS)}
                distinct, place = np.unique(w, return_inverse=True)
                _, at_pair = np.unique(pairs(w), return_inverse=True)
                end = total[WORDS][np.searchsorted(distinct, END)]
                packed = tk.pack(ids, null, held, n, np.array([end]), total[WORDS], place.astype(np.uint32), total[PAIRS][at_pair])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([packed], [TEXTS], [None], [None]), schema.types, strict=True)], schema=schema)

    met = answered.unionByName(texts.select(F.lit(TEXTS).cast("long").alias("kind"), F.lit(0).cast("long").alias("range"), "group", "blob"), allowMissingColumns=True)
    met = met.repartition(parts(texts.sparkSession), "group").sortWithinPartitions("group", "kind", "range")
    return met.mapInArrow(tk.tidy(run), "blob binary, kind long, n long, v long")


def opened(blob: bytes) -> dict[str, np.ndarray]:
    ids, null, held, n, end, total, place, c_pair = tk.unpack(blob)
    c = total[place].astype(np.int64)
    context = np.concatenate([end.astype(np.int64), c[:-1]])
    return {"ids": ids, "null": null.astype(bool), "held": held.astype(bool), "n": n, "c": c, "context": context, "pair": c_pair.astype(np.int64)}


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def histogram(packed: DataFrame, n: int) -> DataFrame:
    """How many training tokens, each left out of the counts, fall where: (bucket, bins) and sums of shares."""

    def fall(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.minimum(-4 * np.log2(np.maximum(p, 1e-12)), BINS - 1).astype(np.int64), 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob in frame["blob"]:
                x = opened(blob)
                t = np.repeat(~x["held"], x["n"])
                p2, p1 = share(x["pair"][t] - 1, x["context"][t] - 1), (x["c"][t] - 1) / max(n - 1, 1)
                key = (bucket(x["context"][t] - 1) << 16) + (fall(p2) << 8) + fall(p1)
                keys, place = np.unique(key, return_inverse=True)
                yield pd.DataFrame({"key": keys, "n": np.bincount(place, minlength=len(keys)), "p2": np.bincount(place, p2, len(keys)), "p1": np.bincount(place, p1, len(keys))})

    return packed.mapInPandas(run, "key long, n long, p2 double, p1 double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))


def learn(found: pd.DataFrame, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) for each bucket, by expectation-maximisation."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    for b, rows in found.groupby(found["key"] // 65536):
        n = rows["n"].to_numpy()
        p = np.stack([rows["p2"] / n, rows["p1"] / n, np.full(len(rows), 1 / (v + 1))])
        w = weights[b]
        for _ in range(rounds):
            mixed = w[:, None] * p
            w = (mixed / mixed.sum(axis=0) * n).sum(axis=1)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        weights[b] = w
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]  # a context never seen has no pairs
    return weights


def scored(packed: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for blob in frame.column("blob").to_pylist():
                x = opened(blob)
                doc = np.repeat(np.arange(len(x["n"])), x["n"])
                add = lambda values, doc=doc, k=len(x["n"]): np.bincount(doc, values, k)
                w = weights[bucket(x["context"])]
                p = w[:, 0] * share(x["pair"], x["context"]) + w[:, 1] * x["c"] / max(n, 1) + w[:, 2] / (v + 1)
                columns = [pa.array(x["ids"], mask=x["null"]), pa.array(x["held"]), pa.array(x["n"]), pa.array(add(x["c"] > 0).astype(np.int64)), pa.array(np.full(len(x["n"]), n)), pa.array(add(np.log10((x["c"] + 1) / (n + v + 1)))), pa.array(add(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return packed.mapInArrow(tk.tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def model(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int, int]:
    """What is counted of docs (doc_id, text, held_out), the mixture weights, N and V."""
    texts = stored(docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")))
    ranges = max(parts(docs.sparkSession), texts.count())
    packed = settle(counted(texts, replies(requests(texts, ranges))))
    sums = packed.where((F.col("blob").isNull()) & (F.col("kind") == WORDS)).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v, packed = int(sums["n"] or 0), int(sums["v"] or 0), packed.where("blob IS NOT NULL").select("blob")
    return packed, learn(histogram(packed, n).toPandas(), v), n, v  # at most BUCKETS * BINS * BINS rows


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of docs (doc_id, text, held_out), learnt from rows that are not held out."""
    return scored(*model(docs))


def op10_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2))
