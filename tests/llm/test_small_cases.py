"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns,
each operator against a brute-force version."""

import hashlib
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilion.llm import cluster, op01_license, op02_chat, op03_bpe, op04_mixing, op05_suffix, op06_topk, op07_embedding, op08_jaccard, op09_toxicity, op10_lm
from profilion.llm import textkit as tk

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids long, size string, target string, n long, name string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 4000, n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(1, 300), prose(2, 60)
    words = base.split()
    near = [" ".join(["x%d" % i if j % 40 == i else w for j, w in enumerate(words)]) for i in range(6)]
    return [
        None, "", "  \n\t ", "one", "One", "two words", base, base, base.upper(), *near, passage, prose(3, 80) + "\n" + passage + " " + prose(4, 80),
        passage + " " + prose(5, 40), prose(6, 30_000), "é ü <|endoftext|> 你好 " * 30, "a" * 700, prose(7, 5), prose(8, 4), base + " " + prose(9, 20),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, "old", 7, "old", "old", 1, "old") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA).repartition(3)


def classes_of(links, n):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_jaccard(docs, texts):
    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    wanted = classes_of(links, len(texts))
    assert len(set(wanted)) < len(texts) - 5
    got = op08_jaccard.classes(docs).toPandas()
    assert len(got) == len(texts) + 1
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), wanted[r.doc_id])


def test_bands_hold_all_partners():
    for percent in (50, 75, 90):
        n = np.arange(1, 3000)
        own, up = op08_jaccard.band(n, percent)
        least = np.maximum((percent * n + 99) // 100, 1)  # the smallest partner of each size
        below, guest = op08_jaccard.band(least, percent)
        assert (np.diff(own) >= 0).all() and ((own == below) | ((own == below + 1) & guest)).all()
        assert up.mean() < 0.6


def test_jaccard_links_across_bands_and_in_large_groups(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 500, 400)]
    rows = [" ".join(words[:300]), " ".join(words[:225 + 4]), " ".join(words[:226]), " ".join(words[:400])]
    rows += [" ".join(f"{w}x" if k == i % 300 else w for k, w in enumerate(words[:300])) + f" end{i}" for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    first = [shingles(t) for t in rows[:60]]
    links = [(i, j) for i, a in enumerate(first) for j, b in enumerate(first[:i]) if 100 * len(a & b) >= 75 * len(a | b)]
    wanted = classes_of(links, len(first))
    got = op08_jaccard.classes(docs).toPandas().set_index("doc_id")
    assert got.loc[range(60), "component_id"].tolist() == wanted and got.loc[range(60), "n_shingles"].tolist() == [len(s) for s in first]
    assert got.loc[range(4, len(rows)), "component_id"].nunique() == 1


def test_jaccard_of_many_short_texts(spark):
    docs = spark.createDataFrame([(i, f"t{i % 2500}") for i in range(5000)], "doc_id long, text string").coalesce(1)
    got = op08_jaccard.classes(docs).toPandas()
    assert (got["component_id"] == got["doc_id"] % 2500).all() and (got["n_shingles"] == 1).all()


def test_suffix(docs, texts):
    rows = [t.encode() for t in [*[t or "" for t in texts], texts[6]]]
    seen = Counter(r[i : i + 200] for r in rows for i in range(len(r) - 199))
    got = op05_suffix.digests(docs).toPandas().set_index("doc_id")
    for k, r in enumerate(rows[:-1]):
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        one = got.loc[[k]].iloc[0]
        assert (one.n_bytes, one.n_removed, one.n_spans, one.kept_sha256) == (len(r), gone.sum(), runs, kept)
    left = op05_suffix.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()


@pytest.mark.parametrize("limits", [{"CROWD": 1}, {"LOCAL": 1}, {"LOCAL": 2, "FAMILY": 1}, {"FAMILY": 1}])
def test_suffix_with_crowded_leads(docs, texts, monkeypatch, limits):
    wanted = op05_suffix.digests(docs).toPandas().sort_values(["doc_id", "n_bytes"]).reset_index(drop=True)
    for name, value in limits.items():
        monkeypatch.setattr(op05_suffix, name, value)
    got = op05_suffix.digests(docs).toPandas().sort_values(["doc_id", "n_bytes"]).reset_index(drop=True)
    assert got.equals(wanted)


def test_suffix_arrays_are_in_order_and_levels_few():
    family, rng = op05_suffix.Family(), np.random.default_rng(0)
    told, seen = [], []
    for share in range(40):
        data = np.frombuffer((prose(share % 25, 400) + "\n").encode(), np.uint8)
        new = op05_suffix.entries(data, np.array([0]), np.array([len(data) - 1]), share)
        leads = [bytes(k)[:32] for k in new["key"]]
        assert leads == sorted(leads) and all(data[w >> 18 : (w >> 18) + 32].tobytes() == k for w, k in zip(new["where"], leads))
        seen += [(k, share, w) for k, w in zip(new["key"].tolist(), new["where"].tolist())]
        told += list(zip(*(x.tolist() for x in family.add(new))))
    assert len(family.levels) <= 7 and len(told) == len(set(told))
    times = Counter(k for k, _, _ in seen)
    assert set(told) == {(s, w) for k, s, w in seen if times[k] > 1} and len(family) == len(times)
    whole = family.whole()["key"]
    assert (whole[1:] > whole[:-1]).all()


def test_suffixes_are_dealt_evenly(spark):
    docs = spark.createDataFrame([(i, prose(100 + i, 2000)) for i in range(40)], "doc_id long, text string").repartition(2)
    sent = op05_suffix.runs(op05_suffix.stored(docs, ["doc_id"]), 8).where(F.col("kind") == op05_suffix.RUN)
    many = Counter()
    for r in sent.select("dest", "blob").collect():
        many[r["dest"]] += len(tk.unpack(bytes(r["blob"]))[0])
    assert len(many) == 8 and max(many.values()) < 1.5 * min(many.values())


def test_bpe(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = op03_bpe.decode(op03_bpe.encode(docs, op03_bpe.tokenizer_path()), op03_bpe.tokenizer_path()).toPandas()
    assert len(got) == len(texts) + 1
    for r in got.itertuples():
        ids = model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == model.decode(ids, skip_special_tokens=False)


def test_mixing(docs):
    sized = docs.withColumn("size", op04_mixing.words())
    got = op04_mixing.mix(sized).withColumn("taken", F.aggregate("plays", F.lit(0).cast("long"), lambda s, p: s + p["words"])).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all()
    got["source"] = got["source"].fillna("~")
    by = got.groupby("source").agg(size=("size", "sum"), all=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["all"]).all() and (abs(by.target - by.taken) <= 1).all()
    weight, cap = np.array([3.0, 1.0, 2.0, 3.0])[: len(by)], 2.0 * by["all"].to_numpy()
    fixed, total = np.zeros(len(by), bool), 1.5 * by["all"].sum()
    while True:  # the excess is shared anew until none is above
        share = np.where(fixed, cap, weight * (total - cap[fixed].sum()) / max(weight[~fixed].sum(), 1e-9))
        if not (above := ~fixed & (share > cap)).any():
            break
        fixed |= above
    assert np.allclose(by.target, share)
    for plays in got["plays"]:
        assert all(0 <= p["position"] <= 1 for p in plays)
    order = op04_mixing.training_order(op04_mixing.mix(sized)).toPandas()["position"]
    assert order.is_monotonic_increasing


def test_mixing_keeps_columns_of_any_name(spark, docs, monkeypatch):
    monkeypatch.setattr(op04_mixing, "RANGE_ROWS", 2)
    clashing = docs.withColumn("size", op04_mixing.words()).withColumns({c: F.lit("mine") for c in ("range_start", "schedule", "mix_source", "mix_order", "mix_start", "doc", "plays", "odd.name")})
    got = op04_mixing.mix(clashing)
    assert got.columns == [*[c for c in clashing.columns if c not in op04_mixing.RESULTS], *op04_mixing.RESULTS]
    assert got.where("range_start = 'mine' AND schedule = 'mine' AND mix_order = 'mine' AND doc = 'mine'").count() == docs.count()
    wanted = op04_mixing.mix(docs.withColumn("size", op04_mixing.words())).select("target").distinct().count()
    assert got.select("target").distinct().count() == wanted


def test_mixing_query_is_in_order_of_position(spark, sf_dir):
    got = op04_mixing.op4_mixing(spark, sf_dir).toPandas()
    known = got["position"].dropna()
    assert known.is_monotonic_increasing and got["position"].isna().sum() == (got["taken"] == 0).sum() and len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_due_time_inverts_a_schedule(spark):
    pieces = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("t0", "t1", "w0", "w1"), p)]) for p in ((0.0, 0.4, 1.0, 3.0), (0.4, 1.0, 3.0, 0.0))])
    got = spark.range(11).select((F.col("id") / 10).alias("g"), op04_mixing.due_time(F.col("id") / 10, pieces).alias("t")).toPandas()
    t = np.linspace(0, 1, 200_001)
    w = np.where(t < 0.4, 1 + t * 5, 3 - (t - 0.4) * 5)
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert np.allclose(np.interp(got["t"], t, done / done[-1]), got["g"], atol=1e-4)


def plain_lm(tokens, train):
    """Counts, weights by expectation-maximisation over single tokens, and a function for log10 probabilities."""
    c, c2 = Counter(), Counter()
    for t in train:
        c.update(t)
        c2.update(zip([0, *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    bucket = lambda x: 1 + int(np.log2(x)) if x > 0 else 0
    seen = {}
    for t in train:
        for a, w in zip([0, *t[:-1]], t):
            k = c[a] - 1
            seen.setdefault(bucket(k), []).append(((c2[a, w] - 1) / k if k > 0 else 0.0, (c[w] - 1) / (n - 1), 1 / (v + 1)))
    weights = {}
    for b, rows in seen.items():
        p, w = np.array(rows).T, np.array([0.3, 0.6, 0.1])
        for _ in range(60):
            mixed = w[:, None] * p
            w = np.maximum((mixed / mixed.sum(axis=0)).mean(axis=1), 1e-6)
            w /= w.sum()
        weights[b] = np.array([0, *(w[1:] / w[1:].sum())]) if b == 0 else w

    def score(t, weights=weights):
        out = 0.0
        for a, w in zip([0, *t[:-1]], t):
            x = weights.get(bucket(c[a]), np.array([0.3, 0.6, 0.1]) if c[a] else np.array([0, 6 / 7, 1 / 7]))
            out += np.log10(x @ np.array([c2[a, w] / c[a] if c[a] else 0.0, c[w] / max(n, 1), 1 / (v + 1)]))
        return out

    return c, n, v, weights, score


def test_lm(docs, texts):
    held = {i: i % 3 == 2 for i in range(len(texts))}
    rows = docs.withColumn("held_out", F.col("doc_id") % 3 == 2)
    got = op10_lm.lm_scores(rows).toPandas()
    tokens = [[*WORD.findall(lower(t)), 0] for t in texts]
    c, n, v, weights, score = plain_lm(tokens, [tokens[i] for i in [*range(len(texts)), 6] if not held[i]])
    _, learnt, many, distinct = op10_lm.model(rows)
    assert (many, distinct) == (n, v) and len(got) == len(texts) + 1
    for b, w in weights.items():
        assert np.abs(learnt[b] - w).max() < 0.02, (b, learnt[b], w)
    for r in got.itertuples():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert np.isclose(r.base_score, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert np.isclose(r.score, score(t, dict(enumerate(learnt)))) and abs(r.score - score(t)) < 0.002 * len(t)


def test_lm_gains_on_held_out_texts(spark, sf_dir):
    got = op10_lm.op10_lm(spark, sf_dir).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_lm_counts_pass_32_bits():
    one = lambda n: tk.pack(tk.deltas(np.array([5, 9], np.uint64)), np.array([n, 0], np.uint64))
    sent, n, v = op10_lm.added_up([one(2**32), one(5)])
    assert (n, v) == (2**32 + 5, 1) and tk.unpack(sent[1])[0].tolist() == [2**32 + 5, 0]


def test_toxicity(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(0, len(texts), 2)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = op09_toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == len(texts) + 1 and got["score"].between(0, 1).all()
    assert got.groupby("doc_id")["score"].nunique().max() == 1
    assert (op09_toxicity.toxicity(docs, labels.limit(0)).toPandas()["score"] == 0.5).all()


def test_toxicity_weights_are_those_of_a_plain_loop(spark):
    rows = [(i, prose(i, 12) + (" vile slur" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    table = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, label int").repartition(3)
    bits, alpha, beta, l1, l2 = 20, 0.3, 1.0, 2.0, 1.0
    order = [r["doc_id"] for r in spark.range(60).orderBy(F.xxhash64("id"), "id").select(F.col("id").alias("doc_id")).collect()]

    z, n = Counter(), Counter()

    def weight(k):
        limit = 0.0 if k == 2**bits else l1
        return 0.0 if abs(z[k]) <= limit else -(z[k] - np.sign(z[k]) * limit) / ((beta + np.sqrt(n[k])) / alpha + l2)

    def hashed(words):
        return np.array([tk.span_hash(tk.prefix_sums(np.frombuffer(w.encode(), np.uint8), tk.FOLDED), np.array([0]), np.array([len(w)]))[0] for w in words])

    for _ in range(3):
        for i in order:
            _, text, y = rows[i]
            w = text.split()
            at = [*sorted({int(x) for x in op09_toxicity.coordinates(hashed(w), np.array([0, len(w)]), bits)[1]}), 2**bits]
            ws = {k: weight(k) for k in at}
            g = 1 / (1 + np.exp(-sum(ws.values()))) - y
            for k in at:
                step = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
                z[k] += g - step * ws[k]
                n[k] += g * g
    wanted = {k: weight(k) for k in z if weight(k) != 0}
    got = op09_toxicity.fit(table)
    assert set(np.flatnonzero(got)) == set(wanted) and all(np.isclose(got[k], w) for k, w in wanted.items())
    few = op09_toxicity.fit(table, most_features=1)
    assert not few.any()


def test_toxicity_of_empty_tables_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert op09_toxicity.toxicity(docs.limit(0), labels).isEmpty()
    own = op09_toxicity.toxicity(docs, labels, out="toxicity").select("score").distinct().collect()
    assert [r["score"] for r in own] == ["old"]


def test_toxicity_learns(spark):
    rows = [(i, prose(i, 40) + (" vile slur" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = op09_toxicity.toxicity(docs, labels).withColumn("held", op09_toxicity.held_out()).where("held").toPandas()
    assert ((got["score"] >= 0.3) == (got["doc_id"] % 3 == 0)).mean() > 0.97


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def some_vectors():
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(60, 8)), 3)
    m[20:40] = m[:20] + np.round(rng.normal(size=(20, 8)) * 0.1, 3)
    m[45] = m[44]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    return [*rows, (100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, [1.0, None] * 4, 0), rows[7]]


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_topk(spark):
    rows = some_vectors()
    found = op06_topk.clean(vectors(spark, rows))
    got = op06_topk.topk(found.where("vec_id % 10 = 0"), found, 5).toPandas()
    kept = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if good(v)]
    for q, a in kept:
        if q % 10 == 0:
            best = sorted(((-int(a @ b), i) for i, b in kept if i != q))[:5]
            one = got[got["query_id"] == q].sort_values("rank")
            assert list(zip(-one["score"], one["vec_id"])) == best
    few = op06_topk.topk(found.where("vec_id = 0"), found.where("vec_id < 3"), 5)
    assert few.count() == 2 and op06_topk.topk(found.limit(0), found, 5).isEmpty()


def test_topk_reads_lists_in_slabs_and_stops():
    rng = np.random.default_rng(4)
    c = np.floor(rng.normal(size=(600, 6)) ** 3 * 1024)
    q, ids = np.floor(rng.normal(size=(20, 6)) * 1024), np.arange(600)
    reading = op06_topk.Reading(c, q)
    for depth in (1, 7, 300, 599, 600):
        reading.read(depth)
        least, most = reading.bounds()
        assert (least <= q @ c.T).all() and (q @ c.T <= most).all()
        a, b = np.nonzero(np.ones((20, 600), bool))
        assert np.array_equal(reading.rest(a, b), (q @ c.T).ravel())
    at, found, score, seen = op06_topk.nra(c, ids, q, np.full(20, -1), np.full(20, -np.inf), 5)
    for k in range(20):
        wanted = sorted(((-s, i) for i, s in enumerate(q[k] @ c.T)))[:5]
        assert sorted(zip(-score[at == k], found[at == k]))[:5] == wanted
    assert seen["read"] < seen["pairs"] * 6 and seen["resolved"] > 0


def test_topk_takes_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op06_topk, "QUERIES", 7)
    monkeypatch.setattr(op06_topk, "BLOCK", 16)
    rng = np.random.default_rng(2)
    table = op06_topk.clean(vectors(spark, [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(200)]))
    rows = {r["vec_id"]: np.array(r["v"]) for r in table.collect()}
    got = op06_topk.topk(table.where("vec_id < 30"), table, 3).toPandas()
    for q in range(30):
        wanted = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q)[:3]
        one = got[got["query_id"] == q].sort_values("rank")
        assert list(zip(-one["score"], one["vec_id"])) == wanted
    assert op06_topk.topk(table.where("vec_id < 3"), table.limit(0), 3).isEmpty()


def test_embedding(spark):
    rows = some_vectors()
    m = {k: np.array(v, np.float32).astype(float) for k, (_, v, _) in enumerate(rows) if good(v) and any(v)}
    links = [(i, j) for i, a in m.items() for j, b in m.items() if i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9]
    label = classes_of(links, len(rows))
    got = op07_embedding.near_duplicates(vectors(spark, rows)).toPandas().sort_values("vec_id")
    assert len(got) == len(rows) and len(links) > 20
    for k, (i, _, _) in enumerate(rows[:-1]):
        one = got[got["vec_id"] == i].iloc[0]
        assert (one.n_links, one.component_id) == (sum(a == k for a, _ in links), rows[label[k]][0])
        assert one.kept == (one.vec_id == one.component_id)
    assert op07_embedding.near_duplicates(vectors(spark, rows).limit(0)).isEmpty()


def test_embedding_groups_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(op07_embedding, "HOME", 1000)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    m = np.concatenate([rng.normal(size=(1000, 16)), centre + rng.normal(size=(2000, 16)) * 0.02])
    table = vectors(spark, [(i, [float(x) for x in v], 0) for i, v in enumerate(m)] + [(5000 + i, [-0.0, 1.0] + [0.0] * 14, 0) for i in range(50)])
    one = cluster.settle(op07_embedding.classes(op07_embedding.prepared(table)))
    made = op07_embedding.range_join(one).count()
    assert made < 5 * 3001
    got = op07_embedding.near_duplicates(table).toPandas().set_index("vec_id")
    u = m.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert got.loc[range(3000), "n_links"].tolist() == (near.sum(axis=1) - 1).tolist()
    assert got.loc[range(1000, 3000), "component_id"].nunique() == 1 and (got.loc[range(5000, 5050), "n_links"] == 49).all()


def test_pivots_are_more_where_vectors_have_one_close_by():
    rng = np.random.default_rng(1)
    r = float(np.sqrt(0.2))
    spread_out = op07_embedding.unit(rng.normal(size=(8000, 64)))
    close = op07_embedding.unit(np.repeat(rng.normal(size=(100, 64)), 80, axis=0)[rng.permutation(8000)] + rng.normal(size=(8000, 64)) * 0.05)
    assert len(op07_embedding.choose(spread_out, 100_000, r)) == 13
    assert len(op07_embedding.choose(close, 100_000_000, r)) > 100


def test_chat_folds_events(spark):
    log = [
        (1, 1, 1, "start", "user", "Hi"), (1, 2, 2, "start", "assistant", None), (1, 3, 2, "delta", None, "bad"), (1, 4, 3, "start", "user", "later"),
        (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "go"), (1, 7, 2, "delta", None, "od </turn> ### \\"), (1, 8, 1, "edit", None, "Hello"),
        (2, 1, 1, "start", None, None), (None, 1, 1, "start", "user", "x"),
    ]
    made = op02_chat.render(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string"))
    text = {r["conv_id"]: "" for r in made.collect()}
    for r in made.orderBy("message").collect():
        text[r["conv_id"]] += r["segment"]
    turns = [(op02_chat.unescape(a), op02_chat.unescape(b)) for a, b in op02_chat.SEGMENT.findall(text[1])]
    assert turns == [("user", "Hello"), ("assistant", "good </turn> ### \\")]
    assert len(op02_chat.SEGMENT.findall(text[2])) == 1 and text[None]
    back = op02_chat.read_back(made.repartition(2, "conv_id")).toPandas().set_index("conv_id")
    assert back.loc[1.0].loss_chars == len("good </turn> ### \\")


def test_chat_of_nulls_ties_long_texts_and_other_columns(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", None, 7, 7), (1, 1, "assistant", long, 7, 7), (1, 1, "assistant", "b", 7, 7), (1, 1, "assistant", "b", 7, 7), (None, 0, None, "x", 7, 7), (2, 0, "assistant", "", 7, 7)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message long, seq long")
    got = {r["conv_id"]: r for r in op02_chat.read_back(op02_chat.render(op02_chat.log_of(table))).collect()}
    turns = "user\n\n" + "assistant\nb\n" * 2 + f"assistant\n{long}\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_chars == len(long) + 2 and got[1].loss_sha256 == hashlib.sha256(("bb" + long).encode()).hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 0
    assert op02_chat.read_back(op02_chat.render(op02_chat.log_of(table.limit(0)))).isEmpty()


def test_bpe_digests(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(op03_bpe.tokenizer_path())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in op03_bpe.digests(docs, op03_bpe.tokenizer_path()).collect():
        ids = model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(model.decode(ids, skip_special_tokens=False).encode()))
    assert op03_bpe.digests(docs.limit(0), op03_bpe.tokenizer_path()).isEmpty() and op03_bpe.encode(docs.limit(0), op03_bpe.tokenizer_path()).isEmpty()


def test_vectors_with_clashing_columns(spark):
    rows = vectors(spark, some_vectors()).withColumns({c: F.lit(1) for c in ("x", "v", "n", "many", "salt", "h1", "block", "score", "rank", "query_id", "component")})
    assert op07_embedding.near_duplicates(rows).columns == ["vec_id", "n_links", "component_id", "kept"]
    found = op06_topk.clean(rows)
    assert op06_topk.topk(found.where("vec_id = 0"), found, 3).count() == 3


def test_license(spark):
    files = [(1, "a/b/x", "text\nReleased under the MIT License."), (2, "a/b/c/y", None), (3, "a/z", ""), (4, None, "Licensed under CC BY-NC 4.0."), (5, "a/b/c/y", "no notice"), (6, "w", "copyright of nobody at all in this line")]
    got = op01_license.scan(spark.createDataFrame(files, "file_id long, path string, text string")).toPandas().set_index("file_id")
    assert got["licence"].where(got["licence"].notna(), None).to_dict() == {1: "MIT", 2: "MIT", 3: None, 4: "CC-BY-NC-4.0", 5: "MIT", 6: None}
    assert got.loc[2].inherited_from == "a/b"


def test_short_notices_of_all_families(spark):
    """The right licence, or none, for short notices whose one word tells a licence from another."""
    by, gnu = "Licensed under CC {} 4.0", "This work is licensed under the GNU {}General Public License, version {}"
    notices = {f"# {by.format(k)}": f"CC-{k}-4.0" for k in ("BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
    notices |= {by.format("BY"): "CC-BY-4.0", "# " + by.format("BY"): "CC-BY-4.0", "// " + by.format("BY") + ".": "CC-BY-4.0", "licensed under cc by 4.0": "CC-BY-4.0"}
    notices |= {gnu.format("", v): f"GPL-{v}.0" for v in "23"} | {gnu.format("Affero ", "3"): "AGPL-3.0", gnu.format("Lesser ", "3"): "LGPL-3.0", gnu.format("Lesser ", "2.1"): "LGPL-2.1"}
    notices |= {f"/* {gnu.format('', v)} */": f"GPL-{v}.0" for v in "23"} | {"This program is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0"}
    notices |= {"This library is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0"}
    notices |= {"Licensed under the Apache License, Version 2.0": "Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the License)": "Apache-2.0", "Licensed under the Apache License, Version 1.1": None}
    notices |= {"Released under the MIT License": "MIT", "// Released under the MIT license.": "MIT", "* Released under the MIT License": "MIT", "MIT License": "MIT", "The MIT License (MIT)": "MIT"}
    notices |= {"Use of this source code is governed by a BSD-style license": "BSD-3-Clause", "BSD 3-Clause License": "BSD-3-Clause", "BSD 2-Clause License": "BSD-2-Clause", "ISC License": "ISC"}
    notices |= {"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0", "Mozilla Public License Version 2.0": "MPL-2.0"}
    notices |= {"This work is licensed under the Creative Commons Attribution 4.0 International License.": "CC-BY-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0"}
    notices |= {"Dedicated to the public domain under the CC0 1.0 Universal license.": "CC0-1.0", "This is free and unencumbered software released into the public domain under the Unlicense license.": "Unlicense", "Licensed under CC BY 3.0": None, "This work is licensed under the GNU General Public License, version 1": None}
    assert len(notices) >= 40
    table = spark.createDataFrame([(k, f"{k}/x", f"some text here\n\n{text}\n\nand more") for k, text in enumerate(notices)], "file_id long, path string, text string")
    got = {r["file_id"]: r["licence"] for r in op01_license.scan(table).collect()}
    assert {text: got[k] for k, text in enumerate(notices)} == notices


def test_license_headers_files_and_spdx(spark):
    gpl = """# Copyright (C) 2021  Jane Roe
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
"""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main() { return 0; }
"""
    whole = {p.stem: p.read_text() for p in (Path(op01_license.__file__).parent / "licences").glob("*.txt")}
    bsd = "/*\n" + "\n".join(textwrap.wrap(whole["BSD-3-Clause"].split("License", 1)[1], 60)) + "\n*/\nint x;\n"
    wanted = {"GPL-3.0": gpl.format(3), "GPL-2.0": gpl.format(2), "MPL-2.0": mpl, "BSD-3-Clause": bsd}
    files = [(name, text) for name, text in wanted.items()] + list(whole.items())
    files += [("MIT", "// SPDX-License-Identifier: MIT\nx"), ("Apache-2.0", "/* SPDX-License-Identifier: apache-2.0 */"), ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"), ("MIT OR Zlib", "# SPDX-License-Identifier: (MIT OR Zlib)"), ("BSD-3-Clause", "BSD 3-Clause License"), (None, "# copyright of nobody at all\n# " + prose(9, 60)), (None, None)]
    table = spark.createDataFrame([(k, f"{k}/x", text) for k, (_, text) in enumerate(files)], "file_id long, path string, text string")
    got = {r["file_id"]: r["licence"] for r in op01_license.scan(table).collect()}
    assert got == {k: name for k, (name, _) in enumerate(files)}


def test_license_of_files_with_null_or_repeated_ids(spark):
    files = [(None, "a/x", "Released under the MIT License."), (None, "b/y", "nothing"), (1, "c/x", "a line\nBSD 3-Clause License"), (1, "d/x", "one\ntwo three"), (2, "a/z", "x"), (3, "e/f", prose(1, 30_000) + "\nGNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n"), (4, "h/g", "SPDX-License-Identifier: Apache-2.0")]
    got = op01_license.scan(spark.createDataFrame(files, "file_id long, path string, text string").withColumns({c: F.lit(1) for c in ("key", "unit", "kind", "word", "licence", "score")}))
    assert {r["path"]: r["licence"] for r in got.collect()} == {"a/x": "MIT", "b/y": None, "c/x": "BSD-3-Clause", "d/x": None, "a/z": "MIT", "e/f": "GPL-3.0", "h/g": "Apache-2.0"}


def test_license_bound_holds_no_bag_back():
    rows, rare = op01_license.template_weights()
    bound = op01_license.Bound([(t, w, i, x) for t, _, w, i, x in rows], rare, op01_license.THRESHOLD)
    rng, vocabulary = np.random.default_rng(0), sorted({w for _, _, w, _, _ in rows}) + ["other", "words"]
    for _ in range(3000):
        bag = Counter(rng.choice(vocabulary, rng.integers(1, 12)).tolist())
        norm = np.sqrt(sum((n * bound.idf.get(w, rare)) ** 2 for w, n in bag.items()))
        dots = Counter()
        for t, _, w, i, x in rows:
            dots[t] += bag[w] * i * x
        assert bound.bag(bag) or max(dots.values()) / norm < op01_license.THRESHOLD


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(500, k) for k in range(501, 700)]
    got = cluster.components(spark.createDataFrame(links, "a long, b long")).toPandas().set_index("node")["component"]
    assert set(got.loc[range(301)]) == {0} and got[650] == 500 and len(got) == 501


def test_topk_of_repeated_queries_and_embedding_of_shared_ids(spark):
    """Every row is one of its own: a repeated query has its answers as often; vectors that share an id have the links of each."""
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (100, [0.2, 1.0]), *[(k, [k / 7 % 1, k / 3 % 1]) for k in range(1, 9)], (3, [0.9, 0.1])]
    table = op06_topk.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = Counter(map(tuple, op06_topk.topk(table.where("vec_id % 100 = 0"), table, 5).collect()))
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    wanted = Counter()
    for i, q in whole:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)
            wanted.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:5]))
    assert got == wanted
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [1.0, 0.02]), (8, [0.01, 1.0]), (9, [1.0, 0.0]), (9, [0.7, 0.71]), (9, None), (3, [0.0, 2.0]), (3, [-1.0, 0.0])]
    found = op07_embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    units_ = [np.array(v) / np.linalg.norm(v) if v else np.zeros(2) for _, v in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and units_[i] @ units_[j] >= 0.9]
    label = classes_of(links, len(rows))
    least = {c: min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in label}
    expected = Counter((rows[i][0], sum(a == i for a, _ in links), least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows)))
    assert Counter(map(tuple, found.select("vec_id", "n_links", "component_id", "kept").collect())) == expected


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert op05_suffix.digests(none).isEmpty() and op08_jaccard.classes(none).isEmpty()
    assert op10_lm.lm_scores(none.withColumn("held_out", F.lit(False))).isEmpty()
    assert op04_mixing.mix(none.withColumn("size", F.lit(1).cast("long"))).isEmpty()
    assert op01_license.scan(none.selectExpr("doc_id AS file_id", "text AS path", "text")).isEmpty()
