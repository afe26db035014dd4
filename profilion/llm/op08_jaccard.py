"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersections.

Texts are sets of word shingles (BITS-bit fingerprints). Two passes over all texts count shingles and write what each set
is known by; a pass over the sets that are to be compared follows each search. (Sets written once and read by all steps were
tried: more disk, 4.1 times the input instead of 2.9, and no less time.) Equal sets are one set from the start. Two sets whose Jaccard similarity reaches the threshold share a shingle
among the first of each in any common order (as many as may be missing, and one), and their sizes lie within the
threshold of each other. A tile therefore holds the sets of one band of sizes that share such a prefix shingle, and as
guests those of the band below that are large enough for a partner in it; bands are BANDS times as wide as the
threshold, so partners lie in one band or in neighbouring ones, and about one set in BANDS is a guest.
All shingles are counted, and the order puts those that many sets hold last, so that common passages make no
tiles. The counts reach the tasks as a filter of bounded size; what it mistakes changes the order alike for all
texts, and the order changes only the work, never the result.

A pair of a tile meets the bitmap test first: each set has a parity signature of about one bit per shingle,
and as signatures differ in no more bits than sets in shingles, the count of differing bits bounds the
overlap from above. Pairs that pass get an exact intersection of sorted arrays.

Groups of near copies are linked to one centre each first: for a few permutations, sets of equal least
shingle are compared with one of them, the set with the fewest shingles of its own (what all copies were made
from has none) or another. What that links is one component, and tiles then make only
pairs between different components, so that a group costs in proportion to its size. A group finds its centre WAYS
ways; pairs to compare meet by their centre, salted SALT ways; a task holds one centre's set at a time.

Cases: null and empty texts and such without words have no shingles, link with nothing and are their own component;
with fewer words than ``width`` the whole sequence is the one shingle; ties do not matter; repeated rows link
like copies; long texts are taken whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.cluster import components, key_filter, may_hold, parts, settle

WIDTH, PERCENT = 5, 75
#: Bits of a shingle, and of a text's place in its chunk.
BITS, ROWS = 54, 10
#: Permutations for centres; parts of a group, and of a centre's pairs; ranges of prefix shingles for each task, and
#: bytes of text for a range; how many times the threshold a band of sizes is wide.
SEEDS, WAYS, SALT, RANGES_PER_TASK, RANGE_BYTES, BANDS = 6, 4, 16, 4, 8 << 20, 8
#: Shingles are counted by COUNTED bits and by blocks of BLOCK. Those that FEW sets hold, or as many more as
#: leaves COMMON of them, go last.
COUNTED, BLOCK, FEW, COMMON = 40, 1 << 20, 6, 2_000_000
#: Sets dealt and pairs formed at a time.
DEALT, FORMED = 2_000, 500_000
Sets = tuple[np.ndarray, np.ndarray, pa.RecordBatch]


def sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Sets]:
    """For each chunk of texts: sorted distinct shingles, one text after the other, where each text begins (and the end),
    and the chunk's rows."""
    for c in tk.chunks(batches, rows=(1 << ROWS) - 1):
        words, first = tk.word_hashes(c)
        values, doc = tk.rolled(words, first, width)
        key = np.sort(doc.astype(tk.U) << tk.U(BITS) | values >> tk.U(64 - BITS))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        cut = np.searchsorted(key, np.arange(len(first)).astype(tk.U) << tk.U(BITS))
        yield key & tk.U(2**BITS - 1), cut, c.rows


def set_names(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A fingerprint for each set."""
    n = np.diff(cut)
    total = np.zeros(len(values) + 1, tk.U)
    np.cumsum(tk.mix(values + tk.U(0xA5A5A5)), out=total[1:])
    return tk.mix(total[cut[1:]] - total[cut[:-1]] + tk.mix(n.astype(tk.U))).view(np.int64)


def signature(values: np.ndarray) -> bytes:
    """Parity bitmap of the next power of two of bits, 64 at least."""
    bits = 64 << max(0, int(np.ceil(np.log2(max(len(values), 1)))) - 6)
    odd = np.bincount((tk.mix(values + tk.U(17)) & tk.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_overlap(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """The bitmap test. A longer signature is folded to the shorter one's bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    # bit k of the longer one counts as bit k modulo the shorter one's length
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    apart = int(np.bitwise_count(x ^ y).sum())
    most = (n_a + n_b - apart) // 2
    return 100 * most >= percent * (n_a + n_b - most)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefixes(values: np.ndarray, cut: np.ndarray, late: np.ndarray, percent: int) -> list[bytes]:
    """Each set's first shingles in the common order, sorted, and each one's place in the order, packed. late: which shingles
    the order puts last."""
    n = np.diff(cut)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(doc * 2 + late, kind="stable")
    values = values[order]
    place = np.arange(len(values)) - cut[:-1][doc]
    keep = place < (n - (percent * n + 99) // 100 + 1)[doc]
    ends = np.concatenate([[0], np.cumsum(keep)])[cut]
    order = np.lexsort((values[keep], doc[keep]))
    values, place = values[keep][order], place[keep][order].astype(np.uint32)
    return [tk.pack(tk.deltas(values[a:b]), place[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def sketches(docs: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """(doc_id, n, rare, name, least, signature, prefix) of every text; rare: how many of its shingles few texts hold; copies
    within a chunk have one prefix."""
    filled = docs.sparkSession.sparkContext.broadcast(last)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, cut, rows in sets(batches, width):
            names, n = set_names(values, cut), np.diff(cut)
            some = n > 0
            least = np.zeros((len(n), SEEDS), np.int64)
            if len(values):
                for k in range(SEEDS):
                    least[some, k] = np.minimum.reduceat(tk.mix(values ^ tk.U(0x9E3779B9 * (k + 1))), cut[:-1][some]).view(np.int64)
            signs = [signature(values[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            late = may_hold(filled.value, tk.mix(values >> tk.U(BITS - COUNTED)))
            rare = np.diff(np.concatenate([[0], np.cumsum(~late)])[cut])
            lists = pa.ListArray.from_arrays(np.arange(0, least.size + 1, SEEDS, dtype=np.int32), least.ravel())
            first = np.zeros(len(n), bool)
            first[np.unique(names, return_index=True)[1]] = True
            prefix = pa.array(prefixes(values, cut, late, percent), pa.binary(), mask=~(first & some))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(rare), pa.array(names), lists, pa.array(signs, pa.binary()), prefix], ["doc_id", "n", "rare", "name", "least", "signature", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(tk.tidy(run), "doc_id long, n long, rare long, name long, least array<long>, signature binary, prefix binary")


def frequent(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """(shingle, n): hashes of the leading COUNTED bits of shingles that FEW texts or more hold. Copies of a text within a
    chunk count once. Blocks send their counts packed, by ranges of shingles, which are then added up."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, tk.U), np.zeros(0, np.int64))
            cut = np.concatenate([[0], np.searchsorted(values, np.array([k * 2**COUNTED // ranges for k in range(1, ranges)], tk.U)), [len(values)]]).astype(int)
            out = [(r, tk.pack(tk.deltas(values[x:y]), n[x:y].astype(np.uint32))) for r, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["range", "blob"])

        for values, cut, _ in sets(batches, width):
            first = np.zeros(len(cut) - 1, bool)
            first[np.unique(set_names(values, cut), return_index=True)[1]] = True
            held.append(values[np.repeat(first, np.diff(cut))] >> tk.U(BITS - COUNTED))
            size += len(held[-1])
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        yield block()

    def total(blobs_of: list[bytes]) -> pa.RecordBatch:
        got = [tk.unpack(x) for x in blobs_of]
        values, place = np.unique(np.concatenate([np.cumsum(x[0]) for x in got]), return_inverse=True)
        n = np.bincount(place, np.concatenate([x[1] for x in got])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tk.mix(values[n >= FEW]).view(np.int64)), pa.array(n[n >= FEW])], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_range(batches):
            yield total(held)

    dealt = docs.select("text").mapInArrow(tk.tidy(deal), "range long, blob binary").repartition(parts(docs.sparkSession), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(tk.tidy(run), "shingle long, n long")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each range, of rows sorted by range."""
    now, held = None, []
    for b in batches:
        for r, blob in zip(b.column("range").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if r != now and held:
                yield held
                held = []
            now = r
            held.append(blob)
    if held:
        yield held


def common(counts: DataFrame) -> np.ndarray:
    """A filter of fixed size for the shingles that go last."""
    by_n = counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy("n").toPandas()  # 10,000 rows at most
    above = by_n["count"][::-1].cumsum()[::-1]
    few = by_n["n"][above <= COMMON]
    return key_filter(counts.where(F.col("n") >= int(few.iloc[0]) if len(few) else F.lit(False)), "shingle")


def checked(pairs: DataFrame, payload: DataFrame, test) -> DataFrame:
    """The pairs (a, b) of names that pass test(a's blob, a's n, b's blob, b's n); payload: (name, n, blob)."""
    salt = F.pmod(F.col("b"), F.lit(SALT))
    guests = pairs.join(payload.withColumnRenamed("name", "b"), "b").select("a", salt.alias("salt"), F.lit(1).alias("guest"), "b", "n", "blob")
    centres = pairs.select("a", salt.alias("salt")).distinct().join(payload.withColumnRenamed("name", "a"), "a").select("a", "salt", F.lit(0).alias("guest"), F.lit(None).cast("long").alias("b"), "n", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, guest, b, n, blob in zip(*(batch.column(k).to_pylist() for k in ("a", "guest", "b", "n", "blob")), strict=True):
                if not guest:
                    now, own = a, (blob, n)
                elif a == now and test(*own, blob, n):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    met = centres.unionByName(guests).repartition(parts(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "guest")
    return met.mapInArrow(tk.tidy(run), "a long, b long")


def blobs(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(name, n, blob): the sorted shingles of the wanted documents (key, a hashed doc_id), and of some others."""
    passing = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "key"))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (b.filter(pa.array(may_hold(passing.value, b.column("key").to_numpy().view(np.uint64)))) for b in batches)
        for values, cut, _ in sets(asked, width):
            some = np.flatnonzero(np.diff(cut) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(set_names(values, cut)[some]), pa.array(np.diff(cut)[some]), pa.array([tk.pack(tk.deltas(values[cut[k] : cut[k + 1]])) for k in some], pa.binary())], ["name", "n", "blob"])

    return docs.select("text", F.xxhash64("doc_id").alias("key")).mapInArrow(tk.tidy(run), "name long, n long, blob binary")


def opened(blob: bytes) -> np.ndarray:
    return np.cumsum(tk.unpack(blob)[0])


def verified(pairs: DataFrame, signs: DataFrame, first_docs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of names that are similar enough: the bitmap test, then the exact one."""
    passed = settle(checked(pairs, signs, lambda a, n, b, m: may_overlap(a, n, b, m, percent)))
    names = passed.select(F.col("a").alias("name")).unionByName(passed.select(F.col("b").alias("name"))).distinct()
    wanted = settle(names.join(first_docs, "name").select(F.xxhash64("doc_id").alias("key")))
    memo: dict[bytes, np.ndarray] = {}

    def test(a: bytes, _n: int, b: bytes, _m: int) -> bool:
        if a not in memo:
            memo.clear()
            memo[a] = opened(a)
        return similar(memo[a], opened(b), percent)

    return checked(passed, settle(blobs(docs, width, wanted)), test)


def band(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each size's band, and whether it may have a partner in the band above. Bands are a little wider than they need be."""
    at = np.log(n) / (-np.log(min(percent, 99) / 100) * BANDS)
    own = np.floor(at)
    return own.astype(np.int64), at - own >= 1 - (1 + 1e-6) / BANDS


def tiles(found: DataFrame, percent: int, ranges: int) -> DataFrame:
    """Pairs (a, b) of names in different components that share a prefix shingle and whose sizes allow a link.

    found: (name, n, component, prefix). A set is at home in the tiles of its shingles and its band of sizes, and a guest
    in those of the band above. A pair that links is made in the tile of the first shingle it shares, at least, which
    lies early enough in both for the overlap to be reached. Postings travel packed by ranges of hashed tiles; in a
    range they are sorted by tile and component, and only what lies in different components pairs up."""
    spark = found.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, DEALT) for whole in batches for at in range(0, whole.num_rows, DEALT)):
            lists = [tk.unpack(x) for x in b.column("prefix").to_pylist()]
            size = np.array([len(x[0]) for x in lists])
            value, place, row = np.concatenate([np.cumsum(x[0]) for x in lists]), np.concatenate([x[1] for x in lists]), np.repeat(np.arange(len(lists)), size)
            own, up = (x[row] for x in band(b.column("n").to_numpy(), percent))
            tile = np.concatenate([tk.mix(x ^ tk.mix((of + 1).astype(tk.U))) >> tk.U(64 - BITS) for x, of in ((value, own), (value[up], own[up] + 1))])
            guest = np.repeat(np.array([0, 1], np.uint8), [len(row), up.sum()])
            place, row = np.append(place, place[up]), np.append(row, row[up])
            order = np.argsort(tile, kind="stable")
            tile, place, row, guest = tile[order], place[order], row[order], guest[order]
            name, n, component = (b.column(k).to_numpy()[row] for k in ("name", "n", "component"))
            own = np.where(component == name, 0, component - name)
            edges = np.searchsorted(tile, np.array([k * 2**BITS // ranges for k in range(1, ranges)], tk.U))
            cut = np.concatenate([[0], edges, [len(tile)]])
            out = [(r, tk.pack(tk.deltas(tile[x:y]), name[x:y], n[x:y].astype(np.uint32), own[x:y], place[x:y], guest[x:y])) for r, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["range", "blob"])

    def pair_up(blobs_of: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [tk.unpack(x) for x in blobs_of]
        tile = np.concatenate([np.cumsum(x[0]) for x in got])
        name, n, own, place, guest = (np.concatenate([x[k] for x in got]) for k in (1, 2, 3, 4, 5))
        component = name + own
        _, which, many = np.unique(tile, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(many[which] > 1)
        tile, name, n, component, place, guest = tile[shared], name[shared], n[shared].astype(np.int64), component[shared], place[shared].astype(np.int64), guest[shared]
        order = np.lexsort((name, component, guest, tile))
        tile, name, n, component, place, guest = tile[order], name[order], n[order], component[order], place[order], guest[order]
        head = np.ones(len(tile), bool)
        head[1:] = (tile[1:] != tile[:-1]) | (name[1:] != name[:-1])  # equal texts of several batches
        tile, name, n, component, place, guest = tile[head], name[head], n[head], component[head], place[head], guest[head]
        fresh = np.ones(len(tile) + 1, bool)
        fresh[1:-1] = tile[1:] != tile[:-1]
        tile_end = np.append(np.flatnonzero(fresh)[1:], len(tile))[np.cumsum(fresh[:-1]) - 1]
        fresh[1:-1] |= (component[1:] != component[:-1]) | (guest[1:] != guest[:-1])
        block_end = np.append(np.flatnonzero(fresh)[1:], len(tile))[np.cumsum(fresh[:-1]) - 1]
        partners = np.where(guest == 0, tile_end - block_end, 0)  # guests meet in the tile where one of them is at home
        at = np.flatnonzero(partners)
        steps = np.cumsum(partners[at])
        for lo in range(0, int(steps[-1]) if len(at) else 0, FORMED):  # however many there are, some at a time
            x, y = np.searchsorted(steps, [lo, lo + FORMED], "right")
            rows = at[x : y + 1]
            begin = np.maximum(block_end[rows], block_end[rows] + lo - (steps[x : y + 1] - partners[rows]))
            stop = np.minimum(tile_end[rows], block_end[rows] + lo + FORMED - (steps[x : y + 1] - partners[rows]))
            many = np.maximum(stop - begin, 0)
            i = np.repeat(rows, many)
            j = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            near = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            # in the tile of the first shingle they share, what follows it bounds the overlap
            near &= (100 + percent) * np.minimum(n[i] - place[i], n[j] - place[j]) >= percent * (n[i] + n[j])
            a, b = np.minimum(name[i[near]], name[j[near]]), np.maximum(name[i[near]], name[j[near]])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            one = np.ones(len(a), bool)
            one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_range(batches):
            yield from pair_up(held)

    dealt = found.mapInArrow(tk.tidy(deal), "range long, blob binary")
    return dealt.repartition(parts(spark), "range").sortWithinPartitions("range").mapInArrow(tk.tidy(run), "a long, b long").distinct()


def near_centres(one: DataFrame) -> DataFrame:
    """Pairs (a, b) of names to try first: each set with one that shares a least shingle, for even seeds that with the
    fewest rare shingles, else any. A group meets its centre in WAYS parts."""
    spots = one.select("name", "rare", F.posexplode("least").alias("seed", "spot"))
    spots = spots.withColumn("rank", F.struct(F.when(F.col("seed") % 2 == 0, F.col("rare")).otherwise(0).alias("rare"), F.xxhash64("name", "seed").alias("any")))
    centre = spots.groupBy("seed", "spot").agg(F.min(F.struct("rank", "name")).alias("c"), F.count("*").alias("many")).where("many > 1")
    centre = centre.select("seed", "spot", F.col("c.name").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("way"))
    pairs = spots.select("name", "seed", "spot", F.pmod(F.xxhash64("name"), F.lit(WAYS)).cast("int").alias("way")).join(centre, ["seed", "spot", "way"]).where("a <> name")
    return pairs.select(F.least("a", "name").alias("a"), F.greatest("a", "name").alias("b")).distinct()


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(parts(docs.sparkSession) * RANGES_PER_TASK, size // RANGE_BYTES)
    last = common(settle(frequent(docs, width, ranges)))
    sketched = settle(sketches(docs, width, percent, last))
    texts = sketched.where("n > 0")
    one = settle(texts.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("least").alias("least"), F.first("signature").alias("signature")))
    signs, first_docs = one.select("name", "n", F.col("signature").alias("blob")), one.select("name", "doc_id")

    near = settle(verified(near_centres(one), signs, first_docs, docs, width, percent))
    groups = settle(components(near).withColumnRenamed("node", "name"))

    # every other link lies between two of these
    found = texts.where("prefix IS NOT NULL").select("name", "n", "prefix").join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
    more = settle(verified(settle(tiles(found, percent, ranges)), signs, first_docs, docs, width, percent))
    label = settle(components(near.unionByName(more)).withColumnRenamed("node", "name"))

    rows = sketched.select("doc_id", "n", "name").join(label, "name", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "name")))
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "component", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
