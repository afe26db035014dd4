"""Numpy kernels over Arrow text, for use inside Spark tasks.

A *chunk* is a slice of an Arrow batch whose texts lie in one byte array, each followed by a line
feed, so words never cross documents.  Hashes are 64-bit polynomial fingerprints read off one
prefix-sum array, which makes the fingerprint of any span two look-ups.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

#: Bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _byte_values(seed: int, fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F) + U(seed)) | U(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


#: A value for each byte: exact, and with A-Z taken as a-z.
EXACT, FOLDED = _byte_values(11, False), _byte_values(12, True)
#: Long texts are fingerprinted in segments of about so many bytes.
SEGMENT = 1 << 18
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64; kept for as many as a segment needs."""

    def made(size: int) -> list[np.ndarray]:
        steps = [np.full(size, b, U) for b in (BASE, INVERSE)]
        for s in steps:
            s[0] = 1
        return [np.multiply.accumulate(s) for s in steps]

    if n > SEGMENT + 4096:
        return tuple(made(n))
    if not _powers:
        _powers.extend(made(SEGMENT + 4096))
    return _powers[0][:n], _powers[1][:n]


def tidy(run):
    """A task function that hands back freed memory at its end, so that a worker kept for later work stays small."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


@dataclass
class Chunk:
    """rows: the batch's slice. data: its texts, each followed by a line feed. lo, hi: where they lie."""

    rows: pa.RecordBatch
    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def ids(self, name: str) -> np.ndarray:
        """A column of integers; null gives the least one."""
        return pc.fill_null(self.rows.column(name).cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SEGMENT, rows: int = 50_000) -> Iterator[Chunk]:
    """Chunks of about ``size`` bytes and at most so many rows; a longer text is a chunk of its own. Null counts as empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(text), "")
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            done = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, done + size, "right"))), at + rows)
            joined = pc.binary_join_element_wise(column.slice(at, to - at), "", "\n")
            joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
            width = np.int64 if pa.types.is_large_string(joined.type) else np.int32
            offsets = np.frombuffer(joined.buffers()[1], width)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
            data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            yield Chunk(batch.slice(at, to - at), data, offsets[:-1], offsets[1:] - 1)
            at = to


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def span_hashes(data: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of many spans, neither of whose ends ever goes back, segment by segment."""
    out, at = np.zeros(len(start), U), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT, "right")))
        lo = start[at]
        out[at:to] = span_hash(prefix_sums(data[lo : end[to - 1]], values), start[at:to] - lo, end[at:to] - lo)
        at = to
    return out


def word_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document (and beyond the last) its first word's index."""
    inside = np.zeros(len(chunk.data) + 1, bool)
    inside[1:] = ~SPACE[chunk.data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    return start, end, np.append(np.searchsorted(start, chunk.lo), len(start))


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint for each word, A-Z taken as a-z, and each document's first word (and the end)."""
    start, end, first = word_spans(chunk)
    return span_hashes(chunk.data, FOLDED, start, end), first


def rolled(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of ``width`` words, repeats included, and each one's document.

    A document of fewer words has its whole sequence as one shingle, one without words none.
    """
    n, factor = np.diff(first), U(0xC2B2AE3D27D4EB4F)
    values = np.zeros(len(words), U)
    for k in range(width):
        values[: len(words) - k] = values[: len(words) - k] * factor + words[k:]
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.arange(len(words)) - first[:-1][doc] + width <= n[doc]
    short = np.flatnonzero((n > 0) & (n < width))
    extra = np.zeros(len(short), U)
    for k in range(width - 1):
        more = n[short] > k
        extra[more] = extra[more] * factor + words[first[:-1][short[more]] + k]
    extra = mix(extra * U(31) + n[short].astype(U))
    return np.append(mix(values[keep]), extra), np.append(doc[keep], short)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        squeezed = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        parts.append(f"{a.dtype.str},{len(a)},{len(squeezed)};".encode() + squeezed)
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        cut = blob.index(b";", at)
        kind, n, size = blob[at:cut].split(b",")
        kind, n, size = np.dtype(kind.decode()), int(n), int(size)
        at = cut + 1 + size
        if n:
            planes = np.frombuffer(pa.decompress(blob[cut + 1 : at], n * kind.itemsize, codec="zstd"), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        else:
            out.append(np.zeros(0, kind))
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    """Differences of sorted values, which pack better; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))
