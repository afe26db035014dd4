"""Robust outliers against a plain version in numpy, and the counts of words, lines and windows against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from profilion.llm import op11_quality as quality

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, x string, pool string, wanted string, own string"


def plain(text):
    """The five counts of a text."""
    words, found = WORD.findall(text or ""), set()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            found |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(found)


def prose(r, n, junk=0.0):
    words = ["".join(chr(97 + k) for k in r.integers(0, 26, r.integers(2, 9))) + ("#" if r.random() < junk else "") + (".\n" if r.random() < 0.1 else "") for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    rows = [(prose(r, int(r.integers(40, 300)), 0.9 if k % 9 == 0 else 0.0), ("en", "de", None)[k % 3], "s0" if k % 4 else None) for k in range(700)]
    rows += [(t, "en", "s0") for t in (None, "", " \n\t", "a b c", "a b c " * 40, "a b c a b c", "x\ny\nx\n \nx\n \n", "é 你 " * 60, prose(r, 60_000), "w" * 100_000, "one " * 49)]
    rows += [(prose(r, 80), f"rare{k}", "tiny") for k in range(30)] + rows[5:9]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k if k % 50 else None, *t, "old", "old", "old", "old", "old") for k, t in enumerate(texts)], SCHEMA).repartition(5)


def test_counts(spark, docs, texts):
    found = quality.measured(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    wanted = [(*p, p[0] < 50 or 100 * p[4] > 50 * p[0]) for p in (plain(t) for t, *_ in texts)]
    assert Counter(map(tuple, found)) == Counter(wanted)


def estimate(x):
    """The same steps in numpy, of one pool's rates in octaves."""
    cov = lambda m: m.T @ m / len(m)
    tolerance = np.diag([quality.SPREAD[k] ** 2 for k in quality.RATES])
    coarse = np.floor(x * quality.STEPS / quality.COARSE) * quality.COARSE / quality.STEPS
    at = lambda q: np.sort(coarse, axis=0)[int(np.ceil(q * len(x))) - 1]
    starts = [(at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)), (x.mean(0), cov(x - x.mean(0)))]
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + tolerance), x - m)
    best = []
    for m, c in starts:
        for _ in range(quality.CONCENTRATIONS):
            bins = np.floor(16 * np.log2(distance(m, c) + 1 / 64))
            n = np.array([(bins < b).sum() for b in bins])
            near = x[n < quality.SHARE * len(x)]
            m, c = near.mean(0), quality.WIDEN * cov(near - near.mean(0))
        best.append((np.linalg.slogdet(c + tolerance)[1], m, c))
    _, m, c = min(best, key=lambda b: b[0])
    near = x[distance(m, c) <= quality.NEAR]
    m, c = near.mean(0), quality.WIDEN_NEAR * cov(near - near.mean(0))
    return distance(m, c)


def test_verdicts(docs, texts):
    found = quality.judged(docs, least=40)
    pools = {}
    for row in found.select("pool", "base_failed", "kept", "distance", *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]).collect():
        if row.base_failed:
            assert not row.kept
        elif row.pool is None:
            assert row.kept and row.distance is None
        else:
            pools.setdefault(row.pool, []).append(row)
    assert len(pools) >= 5
    for rows in pools.values():
        n = np.array([r.n_words for r in rows], float)
        x = np.log2(np.array([[r.word_chars, 1, 1, 1] for r in rows]) / np.stack([n, n / n, n / n, n / n], 1) + np.array([[0, 32 * r.n_symbols / r.n_words, 64 * r.n_dup_lines / r.n_words, 8 * r.n_repeat_words / r.n_words] for r in rows]))
        wanted = estimate(np.rint(x * quality.STEPS) / quality.STEPS)
        assert np.allclose([r.distance for r in rows], wanted, rtol=1e-6, atol=1e-9)
        assert [r.kept for r in rows] == [d <= quality.CUT for d in wanted]
    rejected = {(r.n_symbols > 20) for p in pools.values() for r in p if not r.kept}
    assert rejected == {True}


def test_small_pools_and_nothing(spark, docs):
    """Thirty languages of one text each are judged together, or not at all where even these are too few."""
    few = docs.where("source = 'tiny'")
    assert {r.pool for r in quality.judged(few, least=20).select("pool").collect()} == {"rest"}
    alone = quality.judged(few, least=100).select("pool", "kept").distinct().collect()
    assert alone == [(None, True)]
    assert quality.judged(docs.limit(0)).count() == 0


def test_rerun_is_equal(docs):
    a, b = (quality.judged(docs.repartition(n), least=40).select("doc_id", "distance", "kept") for n in (2, 7))
    assert a.exceptAll(b).isEmpty()


def test_native(spark, sf_dir):
    plan = quality.op11_quality(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
