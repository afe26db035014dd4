"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, neighbouring pairs and pairs with one word between, each hashed to one of
2**bits coordinates and counted once a text. FTRL-proximal (McMahan et al., 2013) gives each coordinate
its own rate; its L1 term keeps most weights at zero, so the model is a short list of (coordinate, weight)
that is at most 2**bits long and safe to broadcast.

The classifier is fitted on a bounded sample: at most ``most`` labelled documents, those of smallest hashed
id, and of these, in that order, those whose whole texts fit in ``most_features`` features together. Everything else
covers all rows: every text is scored whole.

Cases: null or empty texts have no features and score as the bias alone; labels that are null or whose
document is missing are left out; repeated label rows of a document count once (the larger label); of rows that
share an id, the one of least packed features is learnt from, and all are scored; without labels every score is 0.5;
extra columns are carried by ``score`` (one of the name it is to write is replaced) and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.cluster import with_columns

TRAINING_ROWS, TRAINING_FEATURES = 20_000, 50_000_000
BITS = 20
#: predicted is 1 from here on.
THRESHOLD = 0.3


@dataclass
class Ftrl:
    """State of FTRL-proximal: rate alpha, smoothing beta, penalties l1 and l2, on 2**bits coordinates and a bias."""

    bits: int = BITS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(2**self.bits + 1), np.zeros(2**self.bits + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 2**self.bits, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 2**self.bits)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def coordinates(words: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every feature occurrence; repeats are not removed."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    docs, found = [doc], [tk.mix(words)]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x8EBC6AF09C88C6E3)):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        found.append(tk.mix(words[:-gap][same] * tk.U(3) + tk.mix(words[gap:][same] + tk.U(salt))))
    return np.concatenate(docs), (np.concatenate(found) >> tk.U(64 - bits)).astype(np.int64)


def fit(labelled: DataFrame, bits: int = BITS, epochs: int = 3, most_features: int = TRAINING_FEATURES) -> np.ndarray:
    """Weights (2**bits and the bias) from rows (doc_id, text, label), a bounded number of ids."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tk.chunks(batches):
            doc, at = coordinates(*tk.word_hashes(c), bits)
            pairs = np.unique(doc << np.int64(bits) | at)
            cut = np.searchsorted(pairs, np.arange(len(c.lo) + 1) << np.int64(bits))
            at = (pairs & np.int64(2**bits - 1)).astype(np.int32)
            blobs = [tk.pack(at[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([c.rows.column("doc_id"), c.rows.column("label"), pa.array(blobs, pa.binary()), pa.array(np.diff(cut))], ["doc_id", "label", "features", "n"])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Ftrl(bits)
        rows, left = [], most_features
        for f in frames:
            for y, x, n in zip(f["label"], f["features"], f["n"], strict=True):
                if n <= left:
                    rows.append((int(y), x))
                    left -= n
        for _ in range(epochs):
            for y, x in rows:
                model.learn(tk.unpack(x)[0], y)
        w = model.weights(np.arange(2**bits + 1))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"weights": [tk.pack(at.astype(np.int32), w[at])]})

    rows = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = rows.mapInArrow(tk.tidy(features), "doc_id long, label int, features binary, n long")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("features", "n")).alias("x")).select("doc_id", "label", "x.features", "x.n")
    # one task: a row for each sampled id, most_features features in all, in an order that reruns repeat
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features")
    weights = np.zeros(2**bits + 1)
    for row in ordered.mapInPandas(tk.tidy(train), "weights binary").collect():
        at, w = tk.unpack(bytes(row["weights"]))
        weights[at] = w
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, chosen by hashed id."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows of 12 bytes


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, out: str = "score") -> DataFrame:
    """docs with a column of scores; one pass, no shuffle."""
    at = np.flatnonzero(weights).astype(np.int32)
    model = docs.sparkSession.sparkContext.broadcast(tk.pack(at, weights[at]))
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = tk.unpack(model.value)
        dense = np.zeros(2**bits + 1)
        dense[at] = w
        for c in tk.chunks(batches):
            doc, at = coordinates(*tk.word_hashes(c), bits)
            hit = dense[at] != 0
            pairs = np.unique(doc[hit] << np.int64(bits) | at[hit])
            total = np.bincount(pairs >> np.int64(bits), dense[pairs & np.int64(2**bits - 1)], len(c.lo)) + dense[-1]
            column = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*c.rows.columns, column], [*c.rows.schema.names, out])

    return docs.mapInArrow(tk.tidy(run), with_columns(docs.schema, **{out: "double"}))


def held_out(column: str = "doc_id", fold: int = 2, of: int = 4):
    return F.crc32(F.col(column).cast("string")) % of == fold


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS, out: str = "score") -> DataFrame:
    """docs (doc_id, text, ...) with scores, learnt from labels of the documents that are not held out."""
    weights = fit(training_rows(docs, labels.where(~held_out()), label, most))
    return score(docs, weights, out=out)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
