"""The language model against a naive one, and the sums of its contexts."""

import math
import random
from collections import Counter

import pytest

from tessera.operators import corpus as corpus_
from tessera.operators import language_model as lm


def naive(sentences, order, prune):
    """p(word, context) of the recursion as it is written down."""
    raw = Counter()
    for s in sentences:
        plain = [c for c in s if "一" <= c <= "鿿"]
        if plain:
            t = [lm.START, *plain, lm.END]
            for n in range(1, order + 1):
                for i in range(len(t) - n + 1):
                    raw["".join(t[i : i + n])] += 1
    del raw[lm.START]
    left = Counter(g[1:] for g in raw if len(g) > 1)
    a = {g: c if len(g) == order or g[0] == lm.START else left[g] for g, c in raw.items()}
    d = {n: lm.discounts(*(sum(1 for g in a if len(g) == n and a[g] == k) for k in (1, 2, 3, 4))) for n in range(1, order + 1)}
    off = lambda g: d[len(g)][min(a[g], 3) - 1]
    vocab = sorted({g for g in a if len(g) == 1})
    of = {}
    for g in a:
        of.setdefault(g[:-1], []).append(g)

    def p(word, context):
        lower = p(word, context[1:]) if context else 1 / (len(vocab) + 1)
        grams = of.get(context)
        if not grams:
            return lower
        total = sum(a[g] for g in grams)
        kept = [g for g in grams if raw[g] > prune[len(g) - 1]]
        free = sum(off(g) for g in kept) + sum(a[g] for g in grams if g not in set(kept))
        own = a[context + word] - off(context + word) if context + word in kept else 0
        return own / total + free / total * lower

    return p, vocab, a


def corpus(seed, n, letters="的一是在不了有和人这"):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.randint(0, 9)
        out.append("".join(rng.choices(letters, weights=range(1, len(letters) + 1), k=k)) + rng.choice(["", "a1", "，"]))
    return out + out[: n // 3]


@pytest.mark.parametrize(("seed", "n", "order", "prune"), [(1, 300, 4, (0, 0, 1, 1)), (2, 60, 3, (0, 0, 0)), (3, 400, 5, (0, 0, 1, 1, 2)), (4, 8, 4, (0, 0, 1, 1))])
def test_model(spark, seed, n, order, prune):
    sentences = corpus(seed, n)
    p, vocab, a = naive(sentences, order, prune)
    model = lm.train(spark.createDataFrame([(s,) for s in sentences], "sentence string"), order, prune)
    got = {r["gram"]: (r["p"], r["backoff"]) for r in model.collect()}
    assert math.isclose(got[""][0], p("?", ""))
    for g, (prob, _) in got.items():
        assert g in ("", lm.START) or math.isclose(prob, p(g[-1], g[:-1]), rel_tol=1e-9)

    def of_table(word, context):
        """By the table alone, as scores are made."""
        if context + word in got:
            return got[context + word][0]
        return (got.get(context, (0, None))[1] or 1) * of_table(word, context[1:]) if context else got[""][0]

    heads = [h for h, (_, b) in got.items() if b is not None]
    assert heads or n < 10
    for h in heads[:300]:
        assert math.isclose(sum(of_table(w, h) for w in vocab) + of_table("?", h), 1, rel_tol=1e-9)
    asked = [*corpus(seed + 50, 25), "龘的龘一", "", "abc", "的"]
    for bos, eos in ((False, False), (True, True)):
        table = spark.createDataFrame([(t,) for t in dict.fromkeys(asked)], "text string")
        for text, score in lm.scores(table, model, order, bos, eos).collect():
            plain = [c for c in text if "一" <= c <= "鿿"]
            t = [*([lm.START] if bos else []), *plain, *([lm.END] if eos else [])]
            want = sum(math.log10(p(t[i], "".join(t[max(0, i - order + 1) : i]))) for i in range(int(bos), len(t)))
            assert score == pytest.approx(want, abs=2e-6)


def test_long_texts_in_parts(spark, monkeypatch):
    """Grams and scores of a text are those of the whole."""
    model = lm.train(spark.createDataFrame([(s,) for s in corpus(9, 200)], "sentence string"), 3, (0, 0, 0)).cache()
    texts = spark.createDataFrame([("".join(corpus(10, 120)),), ("一的",), ("\n".join(corpus(11, 9)),)], "text string")
    got = {}
    for part in (2, 7, 10_000):
        monkeypatch.setattr(corpus_, "PART", part)
        monkeypatch.setattr(lm, "PART", part)
        grams = Counter(r["gram"] for r in corpus_.char_ngrams(texts, 2, 4, "text").select("gram").collect())
        got[part] = grams, lm.scores(texts, model, 3, True, True).collect()
    assert got[2] == got[7] == got[10_000]
    want = Counter(t[i : i + n] for (t,) in texts.collect() for n in (2, 3, 4) for i in range(len(t) - n + 1))
    assert got[2][0] == want


def test_discounts():
    assert lm.discounts(10, 0, 3, 1) == lm.FALLBACK
    d = lm.discounts(100, 50, 30, 20)
    assert d == (1 - 2 * 0.5 * 50 / 100, 2 - 3 * 0.5 * 30 / 50, 3 - 4 * 0.5 * 20 / 30)
    assert lm.discounts(1, 1, 100, 1) == lm.FALLBACK


def test_no_sentences(spark):
    model = lm.train(spark.createDataFrame([("abc",)], "sentence string"))
    assert {r["gram"] for r in model.collect()} == {"", lm.START}
    assert lm.scores(spark.createDataFrame([("的",)], "text string"), model).first()["lm"] == 0.0
    with pytest.raises(ValueError):
        lm.train(model, prune=(0, 2, 1, 1))
