"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds every repeat of SPAN bytes.

A string of SPAN bytes holds SPAN - LEAD + 1 places of LEAD bytes; the place of the least fingerprint, the
leftmost of equals, is its anchor. Equal strings have equal anchors at equal offsets, so suffixes are indexed
at anchors alone, about one byte in 85. Consecutive strings with one anchor form its stretch, at most
2 * SPAN - LEAD bytes long.

A suffix array holds the suffixes at anchors in order of their first LEAD bytes, and of their stretch's fingerprint
among those that share all of these. Each task keeps an index family: every batch of texts is sorted into a suffix array,
merge-scanned against the levels there are, and then becomes a level itself; levels of like size merge, so
there are logarithmically many. A stretch found again is a repeat as a whole, and is reported at once; the family keeps
one entry of it. Families then send their levels, in order and packed, to the ranges of a hash of the lead, and each
range merges them into a family in the same way. So of a passage that all texts share, a task sends one entry.

In the end, suffixes that share a lead but not the stretch remain. Their stretches' bytes are
fetched, and all their strings of SPAN bytes are looked up by fingerprint among those of the same lead. That
is linear in what there is: no pairs are made. A lead with over LOCAL stretches in one task or CROWD in all is not
brought together: its stretches are asked at once, and their strings counted in Spark, which gives the same.

Stretches and strings are compared by 64-bit fingerprints. Texts travel compressed, in rows of about 256 KB, which are
written once.

Cases: null counts as empty; texts under SPAN bytes lose nothing; repeats inside one text and overlapping ones
count; copies remove each other; repeated rows are texts of their own; no match crosses texts; texts of any
length are taken whole; extra columns are carried by ``remove_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.cluster import parts, settle

SPAN, LEAD, SEGMENT = 200, 32, 1 << 18
#: Stretches of one lead that are brought together from one task, and in all; entries of a task's family; texts for a range.
LOCAL, CROWD, FAMILY, TEXTS_PER_RANGE = 1000, 20_000, 200_000, 64
WHOLE, ASK, STRING, CROWDED, RUN, HOT = range(6)


def anchors(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first string and last string of each anchor's stretch, over texts data[lo:hi]."""
    width, found = SPAN - LEAD + 1, []
    starts = np.zeros(len(data) + 1, np.int32)
    long = hi - lo >= SPAN
    np.add.at(starts, lo[long], 1)
    np.add.at(starts, hi[long] - SPAN + 1, -1)
    inside = np.cumsum(starts[:-1]) > 0
    for a in range(0, max(len(data) - SPAN + 1, 0), SEGMENT):
        b = min(a + SEGMENT, len(data) - SPAN + 1)
        if not inside[a:b].any():
            continue
        part = data[a : b + SPAN - 1]
        sums, at = tk.prefix_sums(part, tk.EXACT), np.arange(len(part) - LEAD + 1)
        low = tk.U(24)
        h = tk.span_hash(sums, at, at + LEAD) >> low << low | at.astype(tk.U)
        # least of each run of ``width``: the least up to a block's end and from a block's start
        n = len(h)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = h
        grid = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[: b - a], ahead[width - 1 : width - 1 + b - a]) & tk.U((1 << 24) - 1)).astype(np.int64)
        good = inside[a:b]
        new = np.ones(b - a, bool)
        new[1:] = (place[1:] != place[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        end = np.ones(b - a, bool)
        end[:-1] = new[1:] | ~good[1:]
        last = np.flatnonzero(end & good)
        found.append((place[first] + a, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def stored(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(share, blob, rows): texts in compressed rows of about 256 KB, and the columns carried as Arrow bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tk.chunks(batches):
            sink = pa.BufferOutputStream()
            rows = c.rows.select(carried)
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([tk.pack(c.lo, c.hi, c.data)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blob", "rows"])

    return settle(docs.mapInArrow(tk.tidy(run), "blob binary, rows binary").withColumn("share", F.monotonically_increasing_id()))


#: An entry's columns: its place in suffix order (lead, stretch, and a byte that is never 0), a hash of its lead, where it
#: lies (share, and a place and its stretch's ends, packed), and whether its stretch is known to repeat.
COLUMNS = ("key", "lead", "share", "where", "many")
Entries = dict[str, np.ndarray]


def entries(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: int) -> Entries:
    """The suffix array of a stored row of texts."""
    place, first, last = anchors(data, lo, hi)
    shape = (place - first).astype(tk.U) << tk.U(32) | (last - first).astype(tk.U)
    stretch = tk.mix(tk.span_hashes(data, tk.EXACT, first, last + SPAN) + tk.mix(shape))
    key = np.ones((len(place), LEAD + 9), np.uint8)
    for k in range(LEAD):
        key[:, k] = data[place + k]
    key[:, LEAD : LEAD + 8] = stretch.astype(">u8").view(np.uint8).reshape(-1, 8)
    key = key.reshape(-1).view(f"S{LEAD + 9}")
    order = np.argsort(key, kind="stable")
    lead, where = tk.span_hashes(data, tk.EXACT, place, place + LEAD), place << 18 | (place - first) << 9 | (last - place + SPAN)
    return {"key": key[order], "lead": lead[order].view(np.int64), "share": np.full(len(place), share), "where": where[order], "many": np.zeros(len(place), bool)}


def ends(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First string of a stretch and the one after its last, from the packed value."""
    place = where >> 18
    return place - (where >> 9 & 511), place + (where & 511) - SPAN + 1


def some(rows: Entries, which: np.ndarray) -> Entries:
    return {k: v[which] for k, v in rows.items()}


class Family:
    """Levels of suffix arrays, the largest first."""

    def __init__(self) -> None:
        self.levels: list[Entries] = []

    def __len__(self) -> int:
        return sum(len(x["key"]) for x in self.levels)

    def add(self, new: Entries) -> tuple[np.ndarray, np.ndarray]:
        """Adds a suffix array; returns (share, where) of stretches that are now known to repeat and were not before."""
        told = []

        def tell(rows: Entries, which: np.ndarray) -> None:
            told.append((rows["share"][which], rows["where"][which]))

        fresh = np.ones(len(new["key"]), bool)
        fresh[1:] = new["key"][1:] != new["key"][:-1]
        group = np.cumsum(fresh) - 1
        repeats = np.bincount(group, minlength=1) > 1
        tell(new, repeats[group] & ~new["many"])
        many = repeats | (np.bincount(group, new["many"], minlength=1) > 0)
        new = some(new, fresh)
        new["many"] = many[: len(new["key"])]
        known = np.zeros(len(new["key"]), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["key"], new["key"]), len(level["key"]) - 1)
            hit = level["key"][at] == new["key"]
            tell(new, hit & ~new["many"])
            old = at[hit]
            tell(level, old[~level["many"][old]])
            level["many"][old] = True
            known |= hit
        if not known.all():
            self.levels.append(some(new, ~known))
        while len(self.levels) > 1 and len(self.levels[-2]["key"]) <= 2 * len(self.levels[-1]["key"]):
            self.merge()
        return tuple(np.concatenate(x) for x in zip(*told, strict=True))

    def merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        both = {k: np.concatenate([b[k], a[k]]) for k in COLUMNS}
        self.levels.append(some(both, np.argsort(both["key"], kind="stable")))

    def whole(self) -> Entries:
        """All entries in one level."""
        while len(self.levels) > 1:
            self.merge()
        return self.levels[0] if self.levels else {k: np.zeros(0, f"S{LEAD + 9}" if k == "key" else bool if k == "many" else np.int64) for k in COLUMNS}


def sharing(lead: np.ndarray) -> np.ndarray:
    """How many entries share each one's lead; equal leads are neighbours."""
    head = np.ones(len(lead), bool)
    head[1:] = lead[1:] != lead[:-1]
    return np.bincount(np.cumsum(head) - 1, minlength=1)[np.cumsum(head) - 1]


INDEXED = "kind long, dest long, where long, lead long, many boolean, blob binary"


def told(kind: int, dest: np.ndarray, where: np.ndarray | None = None, lead: np.ndarray | None = None, many: np.ndarray | None = None, blobs: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(dest)
    column = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    columns = [pa.array(np.full(n, kind)), pa.array(dest, pa.int64()), column(where, pa.int64()), column(lead, pa.int64()), column(many, pa.bool_()), column(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "dest", "where", "lead", "many", "blob"])


def runs(texts: DataFrame, ranges: int) -> DataFrame:
    """Each task's family, by ranges of leads (RUN), with what it found to repeat (WHOLE), and its crowded leads (HOT, and
    their stretches as CROWDED)."""

    def sent(family: Family) -> Iterator[pa.RecordBatch]:
        rows = family.whole()
        crowded = sharing(rows["lead"]) > LOCAL
        yield told(CROWDED, rows["share"][crowded], rows["where"][crowded], rows["lead"][crowded], rows["many"][crowded])
        hot = np.unique(rows["lead"][crowded])
        rows = some(rows, ~crowded)
        # mixed, as leads are places of least fingerprints, which lie close to 0
        into = lambda lead: ((tk.mix(lead.view(tk.U) + tk.U(1)) >> tk.U(32)) * tk.U(ranges) >> tk.U(32)).astype(np.int64)
        yield told(HOT, into(hot), lead=hot)
        to = into(rows["lead"])
        order = np.argsort(to, kind="stable")  # keeps suffix order within a range
        cut = np.flatnonzero(np.diff(to[order], prepend=-1))
        parts_of = [some(rows, order[a:b]) for a, b in zip(cut, [*cut, len(order)][1:], strict=False)]
        yield told(RUN, to[order][cut], blobs=[tk.pack(*(x[k] for k in COLUMNS)) for x in parts_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for b in batches:
            for share, blob in zip(b.column("share").to_pylist(), b.column("blob").to_pylist(), strict=True):
                lo, hi, data = tk.unpack(blob)
                new = entries(data, lo, hi, share)
                if len(new["key"]):
                    yield told(WHOLE, *family.add(new))
                if len(family) > FAMILY:
                    yield from sent(family)
                    family = Family()
        yield from sent(family)

    return texts.select("share", "blob").mapInArrow(tk.tidy(run), INDEXED)


def indexed(sent: DataFrame) -> DataFrame:
    """(kind, share, where, lead, many): stretches that repeat whole, and those whose strings are to be asked."""

    def left(family: Family, hot: list[int]) -> Iterator[pa.RecordBatch]:
        rows = family.whole()
        many, told_hot = sharing(rows["lead"]), np.isin(rows["lead"], np.array(hot, np.int64))
        for kind, which in ((CROWDED, told_hot | (many > CROWD)), (ASK, ~told_hot & (many > 1) & (many <= CROWD))):
            yield told(kind, rows["share"][which], rows["where"][which], rows["lead"][which], rows["many"][which])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family, hot = None, Family(), []
        for b in batches:
            kind = b.column("kind").to_numpy()
            yield b.filter(pa.array(kind < RUN))
            b = b.filter(pa.array(kind >= RUN))
            for k, dest, lead, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "dest", "lead", "blob")), strict=True):
                if dest != now:
                    yield from left(family, hot)
                    now, family, hot = dest, Family(), []
                if k == HOT:
                    hot.append(lead)
                else:
                    yield told(WHOLE, *family.add(dict(zip(COLUMNS, tk.unpack(blob), strict=True))))
        yield from left(family, hot)

    dealt = F.when(F.col("kind") >= RUN, F.col("dest")).otherwise(F.xxhash64("dest", "where"))
    met = sent.withColumn("deal", dealt).repartition(parts(sent.sparkSession), "deal").sortWithinPartitions("deal", "kind").drop("deal")
    return met.mapInArrow(tk.tidy(run), INDEXED).drop("blob").withColumnRenamed("dest", "share")


def by_share(rows: DataFrame, texts: DataFrame, run, schema: str) -> DataFrame:
    """Brings rows (share, a, b, many, crowd) and the stored texts of their share together, the text last."""
    fields = ("a", "b", "many", "crowd")
    both = rows.select("share", F.lit(0).alias("last"), *fields).unionByName(texts.select("share", F.lit(1).alias("last"), "blob", "rows"), allowMissingColumns=True)
    both = both.repartition(parts(texts.sparkSession), "share").sortWithinPartitions("share", "last")
    kinds = (np.int64, np.int64, bool, bool)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            share, is_text = batch.column("share").to_numpy(), batch.column("last").to_numpy() == 1
            at = 0
            for stop in [*np.flatnonzero(is_text), batch.num_rows]:
                if stop > at:
                    if share[at] != now:
                        now, held = share[at], []
                    held.append([batch.column(k).slice(at, stop - at).to_numpy(zero_copy_only=False) for k in fields])
                if stop < batch.num_rows:
                    mine = [np.concatenate(x) for x in zip(*held, strict=True)] if held and share[stop] == now else [np.zeros(0)] * 4
                    yield from run(int(share[stop]), [x.astype(t) for x, t in zip(mine, kinds, strict=True)], batch.column("blob")[stop].as_py(), batch.column("rows")[stop].as_py())
                    held = []
                at = stop + 1

    return both.mapInArrow(tk.tidy(shares), schema)


def gather(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


def strings(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, offset and fingerprint of each of the n strings that begin one after the other at each place."""
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + at
    return row, at, tk.span_hash(tk.prefix_sums(data, tk.EXACT), start, start + SPAN)


ASKED = "kind long, lead long, share long, first long, many boolean, bytes binary"


def asked(asks: DataFrame, texts: DataFrame) -> DataFrame:
    """asks with the bytes of their stretches; for crowded leads, a row for each of their strings, named in lead."""

    def run(share: int, mine: list[np.ndarray], blob: bytes, _rows: bytes) -> Iterator[pa.RecordBatch]:
        where, lead, many, crowd = mine
        if not len(where):
            return
        data = tk.unpack(blob)[2]
        first, stop = ends(where)
        n = stop - first + SPAN - 1
        for kind, which in ((ASK, np.flatnonzero(~crowd)), (STRING, np.flatnonzero(crowd))):
            for at in range(0, len(which), 2_000):
                s = which[at : at + 2_000]
                found = gather(data, first[s], n[s])
                offsets = np.concatenate([[0], np.cumsum(n[s])]).astype(np.int32)
                if kind == ASK:
                    columns = [lead[s], first[s], many[s], pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(found)])]
                else:
                    row, offset, string = strings(found, offsets[:-1].astype(np.int64), n[s] - SPAN + 1)
                    columns = [string.view(np.int64), first[s][row] + offset, many[s][row], pa.nulls(len(row), pa.binary())]
                lead_of, first_of, many_of, held = columns
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lead_of), kind)), pa.array(lead_of), pa.array(np.full(len(lead_of), share)), pa.array(first_of), pa.array(many_of), held], ["kind", "lead", "share", "first", "many", "bytes"])

    rows = asks.select("share", F.col("where").alias("a"), F.col("lead").alias("b"), "many", (F.col("kind") == CROWDED).alias("crowd"))
    return by_share(rows, texts, run, ASKED)


def looked_up(stretches: DataFrame) -> DataFrame:
    """(kind, share, start, end, string, many): spans that repeat; strings of crowded leads pass, each a row."""

    def batch(kind, share, start, end, string, many) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(share), kind)), pa.array(share), pa.array(start), pa.array(end), pa.array(string), pa.array(many)], ["kind", "share", "start", "end", "string", "many"])

    def asked_in(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and fingerprint of each string of some stretches."""
        column = rows.column("bytes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        row, at, string = strings(data, offsets[:-1] - offsets[0], np.diff(offsets) - SPAN + 1)
        return row.astype(np.int32), at + rows.column("first").to_numpy()[row], string

    def spans(rows: pa.Table) -> pa.RecordBatch:
        """A lead's stretches, or those of a few; their strings are made some at a time."""
        found = [(row + np.int32(at), start, string) for at in range(0, len(rows), 1_000) for row, start, string in [asked_in(rows.slice(at, 1_000))]]
        row, start, string = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(string)
        same = string[order[1:]] == string[order[:-1]]
        good = np.zeros(len(row), bool)
        good[order[1:][same]] = True
        good[order[:-1][same]] = True
        row, start = row[good], start[good]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row))[: len(head)] - 1
        share = rows.column("share").to_numpy()[row[head]]
        return batch(WHOLE, share, start[head], start[tail] + SPAN, np.zeros_like(share), np.ones(len(share), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            kind = b.column("kind").to_numpy()
            passed = b.filter(pa.array(kind == STRING))
            share, first, lead = (passed.column(k).to_numpy() for k in ("share", "first", "lead"))
            yield batch(STRING, share, first, first + SPAN, lead, passed.column("many").to_numpy(zero_copy_only=False))
            rows = pa.Table.from_batches([b.filter(pa.array(kind == ASK))])
            rows = rows if held is None else pa.concat_tables([held, rows])
            lead = rows.column("lead").to_numpy()
            begin = int(np.searchsorted(lead == lead[-1], True)) if len(lead) else 0  # the last lead may go on
            for at, to in cut_by(lead[:begin]):
                yield spans(rows.slice(at, to - at))
            held = rows.slice(begin)
        if held is not None and len(held):
            yield spans(held)

    met = stretches.repartition(parts(stretches.sparkSession), "lead").sortWithinPartitions("lead")
    return met.mapInArrow(tk.tidy(run), "kind long, share long, start long, end long, string long, many boolean")


def cut_by(lead: np.ndarray, rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """Pieces of about so many rows that end where a lead ends."""
    at = 0
    while at < len(lead):
        to = min(at + rows, len(lead))
        while to < len(lead) and lead[to] == lead[to - 1]:
            to += 1
        yield at, to
        at = to


def repeats(texts: DataFrame) -> DataFrame:
    """(share, start, end): spans of stored texts whose every string of SPAN bytes occurs elsewhere as well."""
    ranges = max(parts(texts.sparkSession), texts.count() // TEXTS_PER_RANGE)
    found = settle(indexed(runs(texts, ranges)))
    place = F.shiftright("where", 18)
    whole = found.where(F.col("kind") == WHOLE).select("share", (place - F.shiftright("where", 9).bitwiseAND(511)).alias("start"), (place + F.col("where").bitwiseAND(511)).alias("end"))
    looked = settle(looked_up(asked(found.where(F.col("kind") != WHOLE), texts)))
    part = looked.where(F.col("kind") == WHOLE).select("share", "start", "end")
    crowd = looked.where(F.col("kind") == STRING)
    common = crowd.groupBy("string").agg((F.count("*") + F.max(F.col("many").cast("int"))).alias("n")).where("n > 1").select("string")
    return whole.unionByName(part).unionByName(crowd.join(common, "string", "left_semi").select("share", "start", "end"))


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    edges = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(end, minlength=size + 1)[: size + 1]
    return np.cumsum(edges[:size]) > 0


def carried_rows(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeat taken out of text; a character cut through goes as a whole."""
    names = docs.columns
    texts = stored(docs, [n for n in names if n != "text"])

    def run(_share: int, mine: list[np.ndarray], blob: bytes, rows: bytes) -> Iterator[pa.RecordBatch]:
        lo, hi, data = tk.unpack(blob)
        keep = ~covered(len(data), mine[0], mine[1])
        others = carried_rows(rows)
        left = pa.array([data[a:b][keep[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(lo, hi, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([left if n == "text" else others.column(n) for n in names], names)

    spans = repeats(texts).select("share", F.col("start").alias("a"), F.col("end").alias("b"), F.lit(True).alias("many"), F.lit(False).alias("crowd"))
    return by_share(spans, texts, run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs (doc_id, text)."""
    texts = stored(docs.select("doc_id", "text"), ["doc_id"])

    def run(_share: int, mine: list[np.ndarray], blob: bytes, rows: bytes) -> Iterator[pa.RecordBatch]:
        lo, hi, data = tk.unpack(blob)
        gone = covered(len(data), mine[0], mine[1])
        begun = gone.copy()
        begun[1:] &= ~gone[:-1]
        removed, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begun))
        kept = [hashlib.sha256(data[a:b][~gone[a:b]] if k else data[a:b]).hexdigest() for a, b, k in zip(lo, hi, removed[hi] > removed[lo], strict=True)]
        yield pa.RecordBatch.from_arrays([carried_rows(rows).column("doc_id"), pa.array(hi - lo), pa.array(removed[hi] - removed[lo]), pa.array(runs[hi] - runs[lo]), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeats(texts).select("share", F.col("start").alias("a"), F.col("end").alias("b"), F.lit(True).alias("many"), F.lit(False).alias("crowd"))
    return by_share(spans, texts, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
