"""PPMI by hand, vectors against a dense factorisation, likeness by its definition."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.operators import vocabulary, word_vectors as wv


def by_hand(rows, window):
    n = Counter()
    for t in rows:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + window + 1)):
                n[t[i], t[j]] += 1
                n[t[j], t[i]] += 1
    of, total = Counter(), sum(n.values())
    for (a, _), k in n.items():
        of[a] += k
    return n, {p: x for p, k in n.items() if (x := math.log(k * total / (of[p[0]] * of[p[1]]))) > 1e-12}


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(3)
    topics = [[f"{c}{k}" for k in range(14)] for c in "abcd"]
    return [[rng.choice(rng.choice(topics) if rng.random() < 0.15 else t) for _ in range(rng.randint(0, 9))] for t in (rng.choice(topics) for _ in range(700))]


def test_vectors(spark, monkeypatch, sentences):
    monkeypatch.setattr(wv, "BLOCK", 20)
    rows = spark.createDataFrame([(t,) for t in sentences + sentences[:50]], "tokens array<string>").repartition(3)
    pairs = wv.cooccurrences(rows, 3)
    n, want = by_hand(sentences + sentences[:50], 3)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == n
    table = wv.ppmi(pairs)
    got = {(r["a"], r["b"]): r["x"] for r in table.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    names = sorted({a for a, _ in want})
    dense = np.zeros((len(names), len(names)))
    for (a, b), x in want.items():
        dense[names.index(a), names.index(b)] = x
    size, turn = np.linalg.eigh(dense)
    top = np.argsort(-np.abs(size))[:6]
    found, values = wv.vectors(table, dims=6, extra=10, rounds=12)
    assert np.allclose(np.abs(values), np.abs(size[top]), rtol=1e-3)
    v = {r["word"]: r["vector"] for r in found.collect()}
    assert sorted(v) == names
    mine = np.array([v[w] for w in names])
    exact = turn[:, top] * np.sqrt(np.abs(size[top]))
    # vectors agree up to a rotation: their products do
    assert np.abs(mine @ mine.T - exact @ exact.T).max() < 0.02 * np.abs(exact @ exact.T).max()
    full, values = wv.vectors(table, dims=len(names), extra=0, rounds=1)
    assert np.allclose(np.sort(np.abs(values)), np.sort(np.abs(size))[-len(values) :], atol=1e-6)
    assert wv.vectors(table.limit(0))[0].count() == 0


def test_likeness(spark):
    of = {"肝": [1.0, 0.0], "囊肿": [0.0, 1.0], "结节": [0.1, 1.0], "左": [1.0, 1.0]}
    found = spark.createDataFrame(list(of.items()), "word string, vector array<double>")
    like = wv.Likeness(found, vocabulary.costs({w: 5 for w in of}), ignored="可能")
    rows = [("肝囊肿", "肝结节"), ("左肝囊肿", "肝囊肿"), ("xyz", "肝"), (None, "肝"), ("左肝囊肿", "右肝左囊肿"), ("肝可能囊肿", "肝囊肿"), ("肝囊肿", "肝结节")]
    got = [(r["p"], r["q"], r["similarity"]) for r in like(spark.createDataFrame(rows, "p string, q string"), "p", "q").collect()]

    def mean(t):
        t = (t or "").replace("可能", "")
        parts = [w for w in of for _ in range(t.count(w))]
        return np.mean([of[w] for w in parts], axis=0) if parts else None

    def want(p, q):
        x, y = mean(p), mean(q)
        if x is None or y is None:
            return 0.0
        s = x @ y / np.sqrt((x @ x) * (y @ y))
        return s - 0.05 if s > 0.5 and [c for c in p if c in "左右"] != [c for c in q if c in "左右"] else s

    key = lambda r: (str(r[0]), r[1])
    for g, w in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert g[:2] == w and g[2] == pytest.approx(want(*w), abs=1e-5)


def test_checks_take_either_measure(spark):
    """A measure that computes what the checks compute themselves changes nothing; another one does."""
    from pyspark.sql import functions as F

    from tessera.functions.text import bigram_similarity
    from tessera.operators import checks, entities as en
    from tessera.sources.reports import synthetic_reports

    ents = en.entities(synthetic_reports(spark, "/root/testdata/sf0.001")).cache()
    same = lambda pairs, a, b: pairs.withColumn("similarity", F.round(bigram_similarity(F.col(a), F.col(b)), 6))
    parts = lambda pairs, a, b: pairs.withColumn("similarity", checks.illness_similarity(F.col(a), F.col(b)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = rows(checks.contradictions(ents))
    assert rows(checks.contradictions(ents, likeness=same)) == plain
    assert rows(checks.orient_errors(ents, parts)) == rows(checks.orient_errors(ents))
    assert rows(checks.contradictions(ents, likeness=lambda p, a, b: p.withColumn("similarity", F.lit(1.0)))) == [] and plain
