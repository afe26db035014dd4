"""The pipeline and the registered queries over the small tables."""

import re
from collections import Counter

import numpy as np
from oracle import expected, same
from pyspark.sql import functions as F

import corpus_pipeline
from profilion.llm import cluster, op03_bpe, op08_jaccard, op09_toxicity, registry
from profilion.llm import textkit as tk


def test_queries_with_sql(spark, sf_dir):
    queries = registry.queries()
    for name, sql in registry.oracles().items():
        same(queries[name](spark, sf_dir).toPandas(), expected(sql, sf_dir))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = op09_toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")["score"]
    clean = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert set(clean.toPandas()["doc_id"]) == set(scores.index[scores < op09_toxicity.THRESHOLD])
    one = corpus_pipeline.near_duplicates(spark, clean, sf_dir)
    wanted = op08_jaccard.classes(clean).toPandas()["component_id"].unique()
    assert sorted(one.toPandas()["doc_id"]) == sorted(wanted)
    short = corpus_pipeline.repeated_passages(spark, one, sf_dir)
    assert (short.toPandas()["n_chars"] == short.toPandas()["text"].str.len()).all()
    mixed = corpus_pipeline.mixing(spark, short, sf_dir)
    assert clean.columns == one.columns == short.columns == mixed.columns == columns
    assert mixed.toPandas().groupby("doc_id").size().max() <= 2
    assert corpus_pipeline.encoding(spark, mixed, sf_dir).count() == mixed.count()


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and found.where("shard IS NULL OR place IS NULL").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def made(spark, rows):
    return spark.createDataFrame([(k, text, "en", "web", None if text is None else len(text)) for k, text in rows], "doc_id long, text string, lang string, source string, n_chars long")


def told(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def prose(seed, n=80):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 4000, n))


def test_repeated_rows_and_null_ids(spark, sf_dir):
    a, b, c, d, e = (prose(k) for k in range(5))
    docs = made(spark, [(1, a), (1, a), (2, a), (None, b), (None, b), (None, c), (7, c), (4, d), (4, e), (3, e), (5, None), (5, None), (None, "")])
    one = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    wanted = Counter([(1, a), (None, b), (7, c), (4, d), (3, e)])
    assert told(one) == wanted + Counter({(5, None): 2, (None, ""): 1})
    short = corpus_pipeline.repeated_passages(spark, one, sf_dir)
    assert told(short.where("n_chars > 0")) == wanted


def test_null_and_empty_texts_stay(spark, sf_dir):
    a, b = prose(1), prose(2)
    docs = made(spark, [(1, a), (2, a), (3, b), (4, None), (5, ""), (6, None), (7, "short")])
    short = corpus_pipeline.repeated_passages(spark, docs, sf_dir)
    assert told(short) == Counter([(3, b), (4, None), (5, ""), (6, None), (7, "short")])
    assert {r["doc_id"]: r["n_chars"] for r in short.collect()} == {3: len(b), 4: None, 5: 0, 6: None, 7: 5}


def test_own_columns_of_any_name_stay(spark, sf_dir):
    docs = made(spark, [(k, prose(k)) for k in range(6)]).withColumns({c: F.lit(777) for c in ("score", "row_key", "alone", "equal", "bytes_before", "whole", "size", "target", "plays", "schedule")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns and left.where(" AND ".join(f"{c} = 777" for c in docs.columns[5:])).count() == left.count()
        assert left.count() > 0 or stage is corpus_pipeline.toxicity  # no label is of these documents
    last = corpus_pipeline.encoding(spark, docs, sf_dir)
    assert last.where("score = 777").count() == 6 and last.columns == ["doc_id", "lang", "source", "n_chars", *docs.columns[5:], "shard", "place", "n_tokens", "ids"]


def test_empty_tables(spark, sf_dir):
    docs = made(spark, [(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.isEmpty()


def test_mixing_keeps_documents_without_words(spark, sf_dir):
    docs = made(spark, [(1, prose(1)), (2, None), (3, ""), (4, prose(4, 5))])
    got = told(corpus_pipeline.mixing(spark, docs, sf_dir))
    assert got[2, None] == 1 and got[3, ""] == 1 and got[1, prose(1)] in (1, 2)


def plain_stages(spark, rows, labels):
    """The five stages in plain Python over rows (doc_id, text, source); returns what each keeps."""
    word = re.compile("[^\x20\x09-\x0d]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    table = made(spark, [r[:2] for r in rows])
    weights = op09_toxicity.fit(op09_toxicity.training_rows(table, labels.where(~op09_toxicity.held_out()), "toxic"))

    def toxic(text):
        w = word.findall(lower(text))
        folded = np.array([tk.span_hash(tk.prefix_sums(np.frombuffer(x.encode(), np.uint8), tk.FOLDED), np.array([0]), np.array([len(x.encode())]))[0] for x in w], np.uint64)
        at = {int(x) for x in op09_toxicity.coordinates(folded, np.array([0, len(w)]), op09_toxicity.BITS)[1]} if w else set()
        return 1 / (1 + np.exp(-(sum(weights[k] for k in at) + weights[-1]))) >= op09_toxicity.THRESHOLD

    one = [r for r in rows if not toxic(r[1])]

    def shingles(t):
        w = word.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, kept = [shingles(r[1]) for r in one], []
    label = list(range(len(one)))
    for _ in one:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    for k in sorted(set(label)):
        group = [one[i] for i in range(len(one)) if label[i] == k]
        kept += group if not sets[k] else [min(group, key=lambda r: r[0])]

    seen = Counter(t[i : i + 200] for _, text, _ in kept for t in [(text or "").encode()] for i in range(len(t) - 199))
    short = []
    for doc, text, source in kept:
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        left = None if text is None else np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not t or left:
            short.append((doc, left, source))

    size = {r[0]: len(word.findall(r[1] or "")) for r in short}
    total = {s: sum(size[r[0]] for r in short if r[2] == s) for s in {r[2] for r in short}}
    weight = dict(zip(sorted(total), (3.0, 1.0, 2.0) * 9))
    target, open_ = {}, set(total)
    while open_:  # the excess is shared anew
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    order = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(r[0],) for r in short], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(4)).alias("h")).collect()}
    played = Counter()
    for s in total:
        done, ordered = 0, sorted((r for r in short if r[2] == s), key=lambda r: order[r[0]])
        while total[s] and done < round(target[s]):
            for r in ordered:
                words = max(0, min(round(target[s]) - done, size[r[0]]))
                played[r[0]] += words > 0 and 2 * words >= size[r[0]]
                done += size[r[0]]
    for r in short:
        played[r[0]] += size[r[0]] == 0
    return one, kept, short, played


def test_run_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    base, passage = prose(1, 120), prose(2, 60)
    texts = {k: prose(10 + k, 40 + 5 * k) for k in range(24)}
    texts |= {30: base, 31: base, 32: base.replace(base.split()[7], "zzz"), 33: prose(3) + " " + passage + " " + prose(4), 34: passage + " é " + prose(5), 35: None, 36: "", 37: "tiny", 38: passage}
    texts |= {40 + k: prose(60 + k) + (" vile slur" if k % 2 else "") for k in range(60)}
    rows = [(k, t, f"s{k % 3}") for k, t in texts.items()]
    docs = spark.createDataFrame([(k, t, "en", s, None if t is None else len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(40 + k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    one, kept, short, played = plain_stages(spark, rows, labels)
    assert len(rows) > len(one) > len(kept) > len(short) > 20
    got = docs
    for (_, stage), expected_rows in zip(corpus_pipeline.STAGES[:3], (one, kept, short), strict=True):
        got = cluster.written(stage(spark, got, str(tmp_path)))
        assert told(got) == Counter((r[0], r[1]) for r in expected_rows)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in last) == Counter({k: n for k, n in played.items() if n})
    model, text = Tokenizer.from_file(op03_bpe.tokenizer_path()), {r[0]: r[1] for r in short}
    for r in last:
        assert np.frombuffer(r["ids"], "<u4").tolist() == model.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids


def test_rows_with_maps_are_told_apart(spark):
    """Map columns, nested ones too, have no hash of their own; equal rows share a key, all others have keys of their own."""
    rows = [(1, "a", {"x": 1}, [{"y": None}]), (1, "a", {"x": 1}, [{"y": None}]), (1, "a", {"x": 2}, [{"y": None}]), (1, "a", None, None), (None, "a", {}, []), (None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, m map<string,long>, n array<map<string,long>>")
    keyed = corpus_pipeline.row_keys(table, "key")
    assert keyed.columns == ["doc_id", "text", "m", "n", "key"]
    assert sorted(r["count"] for r in keyed.groupBy("key").count().collect()) == [1, 1, 1, 1, 2]
    docs = table.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars", "m", "n")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2
