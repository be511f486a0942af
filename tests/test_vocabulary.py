"""Vocabulary counts and segmentation against plain Python and exhaustive search."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import automaton
from tessera.operators import vocabulary as v

WORDS = st.lists(st.text("ab1.骨质", min_size=1, max_size=4), max_size=9, unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.text("ab1.骨质 ", max_size=24))
def test_places_and_counts(words, text):
    t = automaton.Terms(words)
    want = {(k, i, i + len(w)) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i)}
    assert sorted(t.places(text)) == sorted(want)
    assert {k: (a, b) for k, (a, b, _) in t.counts(text).items()} == {k: (sum(1 for x in want if x[0] == k), text.count(w)) for k, w in enumerate(words) if w in text}


def ways(text, words):
    """Every way to cut a text, with the rest cut likewise."""
    if not text:
        yield []
        return
    run = len(text) - len(text.lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789."))
    for head in {text[: max(1, run)], *(w for w in words if text.startswith(w))}:
        for rest in ways(text[len(head) :], words):
            yield [head, *rest]


@settings(max_examples=150, deadline=None)
@given(WORDS, st.text("ab1.骨质 ", max_size=9), st.randoms())
def test_cut_is_the_cheapest(words, text, rng):
    cost = v.costs({w: rng.choice([1, 2, 5, 50]) for w in words})
    got = v.Lattice(automaton.Terms(words), cost).cut(text)
    assert "".join(got) == text
    price = lambda way: sum(cost[w] if w in cost and w else cost[""] for w in way)

    def cheapest(way):  # a run that is also a word costs the lesser
        return sum(min(cost[""], cost.get(w, cost[""])) for w in way), [-len(w) for w in way]

    best = min(ways(text, words), key=cheapest)
    assert cheapest(got) == cheapest(best) and got == best and price(got) >= 0


def test_frequencies_decide():
    cost = v.costs({"研究": 500, "研究生": 100, "生命": 900, "命": 50, "起源": 300})
    assert v.Lattice(automaton.Terms(sorted(set(cost) - {""})), cost).cut("研究生命起源") == ["研究", "生命", "起源"]
    cost = v.costs({"研究": 5, "研究生": 90_000, "生命": 9, "命": 50_000, "起源": 300})
    assert v.Lattice(automaton.Terms(sorted(set(cost) - {""})), cost).cut("研究生命起源") == ["研究生", "命", "起源"]
    assert v.costs({})[""] == 0 and v.costs({"a": 3, "b": 1})["a"] == round(1e6 * math.log(4 / 3))


def test_counts_and_segments(spark, monkeypatch):
    monkeypatch.setattr(v, "HELD", 3)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(90)] + [None, ""]
    words = ["a", "aa", "aba", "abcab", "c a", "zzz"]
    table = spark.createDataFrame([(w,) for w in [*words, "", None, "a"]], "word string")
    rows = spark.createDataFrame([(t, 1) for t in texts], "text string, word int").repartition(4)
    got = {r["word"]: tuple(r)[1:] for r in v.counts(rows, table).collect()}
    full = [t or "" for t in texts]
    want = {w: (sum(w in t for t in full), sum(t.startswith(w, i) for t in full for i in range(len(t))), sum(t.count(w) for t in full)) for w in words}
    assert got == {w: c for w, c in want.items() if c[1]}
    assert v.counts(rows, table.limit(0)).count() == 0 and v.counts(rows.limit(0), table).count() == 0
    cost = v.word_costs(rows.where("text IS NOT NULL"), words, "text")
    assert cost == v.costs({w: 1 + want[w][1] for w in words})
    cut = v.segmented(rows, cost, "text").collect()
    assert all("".join(r["tokens"]) == (r["text"] or "") for r in cut)
    first = automaton.with_places(rows, words, "text", first_only=True).collect()
    assert sorted((r["text"], r["term"], r["start"], r["stop"]) for r in first) == sorted((t, w, t.index(w), t.index(w) + len(w)) for t in full for w in words if w in t)


def test_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(v, "MOST", 2)
    with pytest.raises(ValueError):
        v.terms_of(spark.createDataFrame([("a",), ("b",), ("c",)], "word string"))


@pytest.mark.parametrize("block", [10, 4_000_000])
def test_more_terms_than_are_sent_meet_the_texts_as_a_table(spark, monkeypatch, block):
    texts = ["abab ababab, aaaa", "", None, "aaaaa-b]ab^c", "ab" * 900 + "!", "字典字典字 ab\nb", "aaaa"] * 2
    terms = ["ab", "aba", "aa", "字典字", "b]", "b\nb", "zz", "ab", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    table = spark.createDataFrame([(t,) for t in terms], "word string")
    want = {tuple(r) for r in v.counts(rows, table).collect()}
    monkeypatch.setattr(v, "SENT", 3)
    monkeypatch.setattr(v, "BLOCK", block)
    monkeypatch.setattr(v, "terms_of", lambda *_: pytest.fail("terms were sent"))
    assert {tuple(r) for r in v.counts(rows, table).collect()} == want and len(want) == 6


RUNS = st.lists(st.lists(st.text("ab字", max_size=12), max_size=4), max_size=6)


@settings(max_examples=150, deadline=None)
@given(RUNS, st.sampled_from([(4_000_000, 1 << 18), (20, 9)]), st.sets(st.integers(1, 12), min_size=1, max_size=4))
def test_blocks_count_all_substrings(texts, limits, sizes):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(v, "PIECE", limits[0])
        m.setattr(v, "WINDOW", limits[1])
        block = v._Block()
        for runs in [*texts, *texts[:1]]:
            block.add(runs, 1)
        got = [tuple(r.values()) for b in block.sums(sorted(sizes), np.full(16, 2**64 - 1, np.uint64)) for r in b.to_pylist()]
    full = [*texts, *texts[:1]]
    each = [x for runs in full for x in runs]
    words = {x[i : i + n] for x in each for n in sizes for i in range(len(x) - n + 1)}
    assert sorted(got) == sorted((w, sum(any(w in x for x in runs) for runs in full), sum(x.startswith(w, i) for x in each for i in range(len(x))), sum(x.count(w) for x in each)) for w in words)


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(False).head().totalShuffleWrite()


def test_texts_substrings_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(v, "SENT", 3)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(20)]
    words = sorted({t[k : k + 4 + k % 9] for t in texts[:4] for k in range(9, 99, 9)})
    rows, table = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a large vocabulary
    try:
        got = {tuple(r) for r in v.counts(rows, table).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(w, sum(w in t for t in texts), sum(t.startswith(w, i) for t in texts for i in range(len(t))), sum(t.count(w) for t in texts)) for w in words}
    assert shuffled(spark) - before < 2 * sum(map(len, texts))
