"""Operators on documents against brute force, with odd rows."""

import hashlib
import itertools
import math
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, common, context_tree, lm_scoring, mixing, quality, sharding, simhash, substring
from tessera.llm.common import Scratch, crc_remainder, lower_words, pack, spread, unpack, word_hashes, words
from tessera.llm.components import components, forest
from tessera.llm.queries import PATTERN, RANKS


def key(rows):
    return sorted(rows, key=repr)


# --- op1 ---------------------------------------------------------------------------------


def ctw(train, depth, across):
    """Counts by (context, node), weighted probabilities, and the next bit's probability, straight from the definition."""
    counts, kids = Counter(), {}

    def before(padded, at):
        """The contexts of a byte, of all depths; beyond ``across`` only within its word."""
        out = [b""]
        for d in range(1, depth + 1):
            cut = d > across and any(c in b" \xff" for c in padded[at - d + 1 : at])
            out.append((b"\0" if cut else padded[at - d : at - d + 1]) + out[-1])
        return out

    for s in train:
        padded = b"\xff" * depth + s
        for at in range(depth, len(padded)):
            contexts = before(padded, at)
            for k in range(8):
                node, bit = (1 << k) | (padded[at] >> (8 - k)), (padded[at] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts[contexts[d], node, bit] += 1
                    if d:
                        kids.setdefault((contexts[d - 1], node), set()).add(contexts[d])

    def n(c, node):
        return counts[c, node, 0], counts[c, node, 1]

    def kt(c, node):
        a, b = n(c, node)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def pw(c, node):
        if (c, node) not in memo:
            memo[c, node] = kt(c, node) if len(c) == depth else np.logaddexp(kt(c, node), sum(pw(x, node) for x in kids.get((c, node), ()))) - math.log(2)
        return memo[c, node]

    def one(c, node):
        out, rest = 0.0, 1.0
        for d in range(depth + 1):
            s = c[len(c) - d :]
            a, b = n(s, node)
            w = 1.0 if d == depth or a + b == 0 else math.exp(kt(s, node) - math.log(2) - pw(s, node))
            out += rest * w * (b + 0.5) / (a + b + 1)
            rest *= 1 - w
        return out

    def score(s):
        padded, total = b"\xff" * depth + s, 0.0
        for at in range(depth, len(padded)):
            for k in range(8):
                p = one(before(padded, at)[depth], (1 << k) | (padded[at] >> (8 - k)))
                total += math.log10(p if (padded[at] >> (7 - k)) & 1 else 1 - p)
        return total

    return score


@pytest.mark.parametrize("depth, across", [(lm_scoring.DEPTH, lm_scoring.ACROSS), (3, 3), (5, 2)])
def test_lm_scores(spark, docs, texts, depth, across):
    small = docs.where("doc_id < 40 OR doc_id IS NULL")
    rows = [(i, t) for i, t in texts if i is None or i < 40]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = lm_scoring.score_documents(small, crc_remainder(F.col("doc_id"), 7) != 2, depth=depth, across=across, block_bytes=2000).toPandas()
    train = [lower_words(t) for i, t in rows if not held(i)]
    counts = Counter(w for ws in train for w in [*ws, b""])
    n, v = sum(counts.values()), len(counts)
    score = ctw([context_tree.stream(ws) for ws in train], depth, across)
    want = []
    for i, t in rows:
        ws = [*lower_words(t), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want.append((-1 if i is None else i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6), score(context_tree.stream(ws[:-1]))))
    have = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got.itertuples()]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) < 1e-7 * max(1, abs(b[6]))


def test_lm_probabilities_sum_to_one():
    grams, n = np.array([0x616263], np.int64), np.array([5])
    t = context_tree.Levels(grams, n, 2, 2)
    reach, rest = context_tree.tops(*(x for x in (np.array([0x62]), np.array([1]), np.array([5]), np.array([0]), np.array([0.0]))))
    every = (np.int64(0x6162) << 8) | np.arange(256)
    assert abs((10 ** t.log10_bytes(every, reach, rest)).sum() - 1) < 1e-9


def test_lm_long_text_in_pieces(monkeypatch):
    s = [b"ab " * 100 + b"\xff", b"\xff", b"abc\xff"]
    whole = {int(r): c for rows, code, starts in lm_scoring._pieces(s, 7, 3) for r, c in zip(rows, np.split(code, starts[1:]), strict=True)}
    monkeypatch.setattr(lm_scoring, "PIECE", 7)
    parts: dict[int, list] = {}
    for rows, code, starts in lm_scoring._pieces(s, 7, 3):
        for r, c in zip(rows, np.split(code, starts[1:]), strict=True):
            parts.setdefault(int(r), []).append(c)
    assert all((np.concatenate(parts[i]) == whole[i]).all() for i in range(3))


def test_lm_empty(none):
    assert lm_scoring.score_documents(none, F.lit(True)).count() == 0


def test_pack():
    for kind in (np.int64, np.float32):
        x = np.arange(100).astype(kind)
        assert (unpack(pack(x), kind) == x).all() and len(unpack(pack(x[:0]), kind)) == 0
    assert set(spread(np.arange(1000), 3)) == {0, 1, 2}


# --- op2 ---------------------------------------------------------------------------------


def test_quality_learns_and_scores_odd_rows(spark, docs, none):
    good = [(i, "Some calm words of a story, told again. " * (3 + i % 5), 1) for i in range(1000, 1060)]
    bad = [(i, "BUY!! NOW!! $$$ &&& ### " * (3 + i % 5), 0) for i in range(2000, 2060)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (3, None), (1000, 1)], "doc_id long, quality int")
    usable = crc_remainder(F.col("doc_id"), 5) != 0
    model = quality.train(table, labels, usable)
    got = dict(quality.score_documents(table, model).collect())
    assert all(got[i] >= 0.3 for i, *_ in good) and all(got[i] < 0.3 for i, *_ in bad)
    odd = quality.score_documents(docs, model)
    assert odd.count() == docs.count() and odd.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score_documents(none, model).count() == 0
    untrained = quality.train(none, labels, usable)
    assert {r[1] for r in quality.score_documents(docs, untrained).collect()} == {0.5}


def test_quality_gradient():
    """The fitted loss falls below that of the constant answer on bags told apart by one passage."""
    rng = np.random.default_rng(1)
    x, bag = rng.normal(0, 0.1, (400, quality.FEATURES)), np.repeat(np.arange(100), 4)
    y = (np.arange(100) % 2).astype(float)
    x[np.flatnonzero(np.arange(400) % 8 == 5), 3] += 3
    m = quality.fit(x, bag, y)
    a, h = m.attend(x)
    e = np.exp(a).reshape(100, 4)
    p = quality._sigmoid(((e / e.sum(1, keepdims=True))[:, :, None] * h.reshape(100, 4, -1)).sum(1) @ m.p["c"] + m.p["b"][0])
    assert ((p > 0.5) == y).mean() > 0.95


def features_by_hand(text):
    """Passages of one text, straight from the definition."""
    raw = text.encode() + b" "
    words, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        words.append((at, w))
        at += len(w)
    starts = [words[k][0] for k in range(0, len(words), quality.PASSAGE)] or [0]
    starts[0] = 0
    out = []
    had, pairs = set(), set()
    for k, a in enumerate(starts):
        chunk = raw[a : starts[k + 1] if k + 1 < len(starts) else len(raw)]
        row = [sum(quality._class[c] == q for c in chunk) / len(chunk) for q in range(quality._CLASSES)]
        mine = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        cells = []
        for j, (_, w) in enumerate(mine):
            i = k * quality.PASSAGE + j
            upper = sum(65 <= c <= 90 for c in w)
            pair = (w, words[i + 1][1]) if i + 1 < len(words) else None
            n = min(len(w), 40)
            cells.append((n / 10, n * n / 100, upper == len(w) > 1, 65 <= w[0] <= 90, quality._class[w[-1]] >= 4, len(w) == 1 and quality._class[w[0]] >= 4, w in had, pair in pairs))
            had.add(w)
            if pair:
                pairs.add(pair)
        out.append(row + list(np.mean(cells, axis=0) if cells else np.zeros(8)))
    return np.array(out)


ODD_TEXTS = ["", " \n ", "  Two words\n", "THE the The the THE the . ! Ünder " * 70, "a b " * 300 + "\n\n c" * 40, "x" * 900 + " y\tz " * 200]


@pytest.mark.parametrize("piece", [1 << 21, 700])
def test_quality_features(monkeypatch, piece):
    """The encoder against a naive one; texts in parts give the passages of one piece, whatever stands beside them."""
    monkeypatch.setattr(quality, "PIECE", piece)
    got = [[] for _ in ODD_TEXTS]
    for rows, x, bag in quality.encode_texts(ODD_TEXTS):
        for k, r in enumerate(rows):
            got[r].append(x[bag == k])
    for text, mine in zip(ODD_TEXTS, got, strict=True):
        assert np.allclose(np.concatenate(mine), features_by_hand(text))


def test_quality_forward_pass(monkeypatch):
    """Gated attention by hand, in one piece and in parts, and nothing lost beyond two megabytes."""
    rng = np.random.default_rng(1)
    n, h, g = quality.FEATURES, quality.HIDDEN, quality.GATE
    p = {"W": rng.normal(size=(n, h)), "w0": rng.normal(size=h), "T": rng.normal(size=(h, g)), "S": rng.normal(size=(h, g)), "v": rng.normal(size=g), "c": rng.normal(size=h), "b": np.array([0.3])}
    model = quality.Model(rng.normal(size=n), rng.uniform(0.5, 2, n), p)
    want = []
    for t in ODD_TEXTS:
        x = ((features_by_hand(t) - model.mean) / model.scale).clip(-8, 8)
        e = np.tanh(x @ p["W"] + p["w0"])
        a = np.exp((np.tanh(e @ p["T"]) / (1 + np.exp(-(e @ p["S"])))) @ p["v"])
        want.append(1 / (1 + np.exp(-((a / a.sum()) @ e @ p["c"] + 0.3))))
    assert np.allclose(model.score(ODD_TEXTS), want)
    monkeypatch.setattr(quality, "PIECE", 700)
    assert np.allclose(model.score(ODD_TEXTS), want)
    monkeypatch.undo()
    prose = " ".join(f"w{k % 997}\n" if k % 9 == 0 else f"w{k * k % 499}" for k in range(460_000))
    long = model.score([prose])
    assert len(prose) > quality.PIECE
    monkeypatch.setattr(quality, "PIECE", 1 << 23)
    assert np.allclose(model.score([prose]), long)


# --- op3 ---------------------------------------------------------------------------------


def roots(names, linked):
    up = {n: n for n in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[find(a)] = find(b)
    return {n: find(n) for n in names}


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash(docs, texts, none, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    got = simhash.near_duplicates(docs).collect()
    prints = [simhash.fingerprint(t) for _, t in texts]
    root = roots(set(prints), [(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 2])
    low = {}
    for (i, _), p in zip(texts, prints, strict=True):
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    assert key(map(tuple, got)) == key([(i, f"{p:016x}", low.get(root[p])) for (i, _), p in zip(texts, prints, strict=True)])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash_links_on_random_prints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    from tessera.llm.common import Scratch
    from tessera.llm.components import components

    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)] + [0, 2**64 - 1]
    prints = set(base)
    for b in base[:20]:
        for _ in range(6):
            x = b
            for k in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(k)
            prints.add(x)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    s = Scratch(spark)
    found = dict(components(simhash.links(df, s), s).collect())
    root = roots(prints, [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 2])
    groups = lambda f: {frozenset(p for p in prints if f(p) == r) for r in map(f, prints)}
    assert groups(lambda p: found.get(simhash._signed(p), simhash._signed(p))) == groups(root.get)


def test_simhash_keep_first(docs, texts):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_duplicates(docs).select(F.coalesce(F.col("component_id").cast("string"), "fingerprint")).distinct().count()


def jaccard(a, b, width=5):
    sets = [{b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (lower_words(a), lower_words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def fingerprint_by_hand(text, width=3):
    w = lower_words(text)
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) > width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum((1 << k) for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_by_hand(docs, texts):
    extra = ["A b C", "a b a b a b a b", "É ß Ünder É ß", "x " * 9000]
    assert all(simhash.fingerprint(t) == fingerprint_by_hand(t) for _, t in texts) and all(simhash.fingerprint(t) == fingerprint_by_hand(t) for t in extra)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint").collect()
    assert key(map(tuple, got)) == key((i, f"{fingerprint_by_hand(t):016x}") for i, t in texts)


def test_crowded_keys_at_their_size(spark):
    """Hundreds of fingerprints that share a key: those within two bits are connected, the others not."""
    rng = np.random.default_rng(12)
    low = rng.choice(1 << 32, 600, replace=False).tolist()
    crowd = [(0xABCD1234 << 32) | x for x in low]
    crowd += [x ^ (1 << int(rng.integers(32))) ^ (1 << int(rng.integers(32))) for x in crowd[:300]]
    crowd = sorted(set(crowd))
    df = spark.createDataFrame([(simhash._signed(p),) for p in crowd], "print long")
    s = Scratch(spark)
    found = dict(components(simhash.links(df, s), s).collect())
    arr = np.array(crowd, np.uint64)
    x, y = np.nonzero(np.bitwise_count(arr[:, None] ^ arr) <= 2)
    want = forest(len(crowd), x, y)
    got = [found.get(simhash._signed(p), simhash._signed(p)) for p in crowd]
    assert len(crowd) > 10 * simhash.CROWD
    groups = lambda f: {frozenset(np.flatnonzero(np.array(f) == r).tolist()) for r in set(f)}
    assert groups(got) == groups(want.tolist())


def test_pivot_table_discards_unrelated_pairs():
    """Of unrelated fingerprints most go by the largest coordinate difference alone; of similar texts hardly any."""
    rng = np.random.default_rng(6)
    far = simhash.far_table(rng.integers(0, 2**64, (2000, simhash.WORDS), dtype=np.uint64)).astype(int)
    most = simhash.most_turned(0.8)
    assert (np.abs(far[::2] - far[1::2]).max(axis=1) <= most).mean() < 0.35
    near = []
    for _ in range(400):
        sets = rng.integers(0, 2**64, 100, dtype=np.uint64)
        near += [simhash.wide_fingerprint(sets[:90]), simhash.wide_fingerprint(sets[10:])]  # 80 of 100
    near = simhash.far_table(np.stack(near)).astype(int)
    assert (np.abs(near[::2] - near[1::2]).max(axis=1) <= most).mean() > 0.985


@pytest.mark.parametrize("few, hot", [(4, 20_000), (1, 20_000), (4, 2)])
def test_similar_texts(spark, docs, none, monkeypatch, few, hot):
    """Copies with some words changed link, others don't; nothing depends on how many share a key."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(5)
    base = [[f"v{k}" for k in rng.integers(0, 3000, 300)] for _ in range(30)]
    rows = [(100 * i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):
        for c in range(1, 4):
            w = list(b)
            for at in rng.choice(300, 3, replace=False):
                w[at] = "new"
            rows.append((100 * i + c, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.similar_rows(table, 0.8, 5).collect()}
    assert all(jaccard(rows[i][1], next(t for d, t in rows if d == 100 * i + 1)) >= 0.8 for i in range(20))
    assert len({got[100 * i] for i in range(30)}) == 30
    assert np.mean([got[d] == got[d - d % 100] for d in got]) > 0.95
    kept = {r["doc_id"] for r in simhash.keep_dissimilar(table).collect()}
    assert {100 * i for i in range(30)} <= kept and len(kept) <= 33
    odd = simhash.similar_rows(docs, 0.8, 5)
    assert odd.count() == docs.count() and odd.where("root IS NULL").count() == 0
    assert simhash.keep_dissimilar(docs).columns == docs.columns
    assert simhash.keep_dissimilar(none).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_hot_keys(spark, monkeypatch, alike):
    """Keys of more members than one task looks at, near each other or not: all that are near get connected."""
    monkeypatch.setattr(simhash, "HOT", 40)
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**64, simhash.WORDS, dtype=np.uint64)
    rows = []
    for k in range(400):
        wide = core.copy() if alike else rng.integers(0, 2**64, simhash.WORDS, dtype=np.uint64)
        wide[k % simhash.WORDS] ^= np.uint64(1 << k % 61)
        rows.append((k, wide))
        if not alike and k % 2:
            rows.append((k + 1000, rows[-1][1] ^ np.uint64(9)))
    table = spark.createDataFrame([(k, w.tobytes(), np.full(simhash.BANDS, 7, np.int64).tobytes()) for k, w in rows], "body long, wide binary, keys binary")
    s = Scratch(spark)
    edges = [(r["x"], r["y"]) for r in simhash._candidates(table, 0.8, s).collect()]
    root = {k: k for k, _ in rows}
    names = sorted(root)
    at = {k: i for i, k in enumerate(names)}
    root = forest(len(names), np.array([at[x] for x, _ in edges]), np.array([at[y] for _, y in edges]))
    assert (root == 0).all() if alike else all(root[at[k]] == root[at[k + 1000]] for k in range(1, 400, 2)) and len(set(root)) >= 380


def test_similar_documents_of_the_tables(spark):
    """Against brute force on real rows: no text goes without a partner of 0.8 or more, and hardly a pair is missed."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables aren't there")
    table = spark.read.parquet(path).select("doc_id", "text")
    rows = {}
    for r in table.orderBy("doc_id").collect():
        rows.setdefault(r["text"], r["doc_id"])
    ids, sets = list(rows.values()), [simhash.shingle_hashes(t, 5) for t in rows]
    holders: dict[int, list[int]] = {}
    for k, h in enumerate(sets):
        for x in h.tolist():
            holders.setdefault(x, []).append(k)
    shared = Counter((a, b) for ks in holders.values() if len(ks) > 1 for i, a in enumerate(ks) for b in ks[i + 1 :])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    got = {r["doc_id"]: r["root"] for r in simhash.similar_rows(table, 0.8, 5).collect()}
    joined = [got[ids[a]] == got[ids[b]] for a, b in pairs]
    want = forest(len(ids), *np.array(pairs).T)
    members = Counter(got[i] for i in ids)
    assert len(pairs) >= 5 and np.mean(joined) >= 0.95
    assert all(members[got[i]] == 1 or want[k] != k or (want == k).sum() > 1 for k, i in enumerate(ids))


@pytest.mark.parametrize("cut", [2048, 3])
def test_similar_texts_are_verified(spark, monkeypatch, cut):
    """Components of exact similarity 0.8, around the threshold, in short texts and in groups of several slices."""
    monkeypatch.setattr(simhash, "SLICE", cut)
    rng = np.random.default_rng(8)
    texts = []
    for n, changes in [(9, range(2)), (14, range(2)), (40, range(3)), (120, range(8)), (300, range(12))]:
        for _ in range(12):
            base = [f"v{k}" for k in rng.integers(0, 5000, n)]
            for c in changes:
                w = list(base)
                for at in rng.choice(n, c, replace=False):
                    w[at] = "new"
                texts += [w, w[:-1]]
    texts = sorted({" ".join(w) for w in texts})
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    assert any(0.8 <= jaccard(texts[i], texts[j]) < 0.81 for i, j in pairs)
    want = forest(len(texts), *np.array(pairs).T)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.similar_rows(table, 0.8, 5).collect()}
    groups = lambda f: {frozenset(k for k in range(len(texts)) if f[k] == r) for r in set(f[k] for k in range(len(texts)))}
    assert groups(got) == groups(want)


# --- op4 ---------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(n, seed):
    at = sharding.permute(np.arange(n), n, seed)
    assert sorted(at) == list(range(n)) and (sharding.permute(at, n, seed, back=True) == np.arange(n)).all()


def test_sharding(docs, texts, none, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 1)
    got = sharding.shard_rows(docs, 7).collect()
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == key((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = Counter(r["shard"] for r in got)
    assert max(slots.values()) - min(slots.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s, n in slots.items() for k in range(n)}
    assert key(map(tuple, got)) == key(map(tuple, sharding.shard_rows(docs.repartition(5), 7).collect()))
    assert sharding.shard_rows(none, 7).count() == 0


# --- op6 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab É  \n\t's're1²!漢 \x1c_٣\r"), max_size=40), st.integers(1, 8))
def test_pieces_have_the_tokens_of_the_whole(text, size):
    ranks = bpe.read_ranks(RANKS)
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.encode(text, ranks, PATTERN, size) == bpe.encoding(ranks, PATTERN).encode_ordinary(text)


def test_bpe(docs, texts, none, ranks):
    enc = bpe.encoding(ranks, PATTERN)
    want = []
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert key(map(tuple, bpe.round_trip(docs, ranks, PATTERN).collect())) == key(want)
    back = bpe.decode_documents(bpe.encode_documents(docs, ranks, PATTERN), ranks, PATTERN).collect()
    assert key((r[0], bytes(r[1])) for r in back) == key((i, (t or "").encode()) for i, t in texts)
    assert bpe.round_trip(none, ranks, PATTERN).count() == 0
    assert public_tokenizers.path("x")


# --- op7 ---------------------------------------------------------------------------------


def test_shares_stop_at_the_cap():
    out = mixing.shares({"a": 10, "b": 100, None: 100}, {"a": 5, "b": 2, None: 1}, 315, 2)
    assert out["a"] == 20 and abs(sum(out.values()) - 315) < 1e-9 and max(out["b"], out[None]) <= 200


def test_flow_repeats_as_little_as_it_can():
    flow = mixing.route({("a",): 10, ("a", "b"): 20, ("b",): 5}, {"a": 25, "b": 15}, 2)
    total = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(total.values()) == 40 and sum(f.get("a", 0) for f in flow.values()) == 25
    assert sum(max(0, total[p] - n) for p, n in {("a",): 10, ("a", "b"): 20, ("b",): 5}.items()) == 5


def test_mixing(docs, texts, none):
    got = mixing.mix_sizes(docs).collect()
    assert key((r["doc_id"], r["size"]) for r in got) == key((i, len(words(t))) for i, t in texts)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert key(map(tuple, got)) == key(map(tuple, mixing.mix_sizes(docs.repartition(2)).collect()))
    target, taken, largest = {}, Counter(), Counter()
    for r in got:
        s = (r["source_size"], round(r["target"], 6))
        target[s] = r["target"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], 3 * r["size"])  # one row is there three times, decided together
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert mixing.mix_sizes(none).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


@given(st.tuples(*[st.integers(0, 2)] * 3), st.tuples(*[st.integers(0, 6)] * 2))
@settings(max_examples=25, deadline=None)
def test_route_is_the_cheapest_greatest_flow(sizes, wants):
    """Against all flows of three patterns and two overlapping sources."""
    patterns = {("a",): sizes[0], ("b",): sizes[1], ("a", "b"): sizes[2]}
    targets, repeats = dict(zip("ab", wants, strict=True)), 2
    price = lambda n, size: sum(r * min(size, max(0, n - r * size)) for r in range(1, repeats))
    best = None
    for a, b, x, y in itertools.product(*(range(repeats * s + 1) for s in (sizes[0], sizes[1], sizes[2], sizes[2]))):
        if a + x <= wants[0] and b + y <= wants[1] and x + y <= repeats * sizes[2]:
            at = (-(a + b + x + y), price(a, sizes[0]) + price(b, sizes[1]) + price(x + y, sizes[2]))
            best = at if best is None else min(best, at)
    flow = mixing.route(patterns, targets, repeats)
    got = [sum(flow[p].values()) for p in patterns]
    assert all(sum(f.get(s, 0) for f in flow.values()) <= targets[s] for s in "ab")
    assert (-sum(got), sum(price(n, s) for n, s in zip(got, sizes, strict=True))) == best


def test_route_of_many_patterns():
    """Twenty thousand patterns of forty sources; no pattern could repeat less, as a cut of sources shows that all words are needed."""
    rng = np.random.default_rng(8)
    patterns = {}
    while len(patterns) < 20_000:
        patterns[tuple(sorted(f"s{k:02}" for k in rng.choice(40, rng.integers(1, 6), replace=False)))] = int(rng.integers(0, 1000))
    total = sum(patterns.values())
    weights = rng.random(40)
    targets = {f"s{k:02}": int(1.5 * total * w / weights.sum()) for k, w in enumerate(weights)}
    flow = mixing.route(patterns, targets, 2)
    out = {p: sum(f.values()) for p, f in flow.items()}
    got = {s: sum(f.get(s, 0) for f in flow.values()) for s in targets}
    assert all(out[p] <= 2 * n for p, n in patterns.items()) and all(got[s] <= t for s, t in targets.items())
    # sources that fall short get all that their patterns can give
    short = {s for s in targets if got[s] < targets[s]}
    assert all(out[p] == 2 * n for p, n in patterns.items() if short & set(p))


@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 5)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.tuples(*[st.integers(0, 9)] * 3), st.integers(1, 3))
@settings(max_examples=120, deadline=None)
def test_route_against_cuts(made, wants, repeats):
    """The greatest flow of every repetition is the least cut over sets of sources."""
    names = "abc"
    patterns = {tuple(names[k] for k in range(3) if bits >> k & 1): size for bits, size in made}
    targets = dict(zip(names, wants, strict=True))
    flow = mixing.route(patterns, targets, repeats)
    out = {p: sum(f.values()) for p, f in flow.items()}

    def most(times):
        return min(sum(targets[s] for s in cut) + sum(times * n for p, n in patterns.items() if not set(p) <= set(cut)) for k in range(4) for cut in itertools.combinations(names, k))

    # words of the first r repetitions: as many as r repetitions could carry, for every r
    for r in range(1, repeats + 1):
        assert sum(min(n, r * patterns[p]) for p, n in out.items()) == most(r)
    assert all(sum(f.get(s, 0) for f in flow.values()) <= targets[s] for s in names)


def test_mixing_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else None) for i in range(90)], "doc_id long, text string, m array<string>")
    out = mixing.mix_documents(df, targets={"a": 300.0, "b": 150.0, None: 30.0}, members=F.col("m"))
    assert out.columns == df.columns and abs(out.count() - 48) <= 3


# --- op9 ---------------------------------------------------------------------------------


def removed_by_hand(rows, width):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - width + 1):
            k = b" ".join(w[a : a + width])
            first[k] = min(first.get(k, math.inf), math.inf if i is None else i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if first[b" ".join(w[a : a + width])] < (math.inf if i is None else i):
                gone[a : a + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [50, 3])
def test_substring(docs, texts, none, width):
    got = substring.substring_digest(docs, width=width, block_bytes=5000).collect()
    assert key(map(tuple, got)) == key(removed_by_hand(texts, width))
    assert substring.substring_digest(none).count() == 0


def test_substring_with_odd_ids(spark):
    """The largest and negative longs are ids like others; rows without id come last and take nothing from others."""
    passage = " ".join(f"p{k}" for k in range(55))
    late = " ".join(f"q{k}" for k in range(52))
    rows = [(2**63 - 1, f"a {passage} {late}"), (-5, f"{passage} b"), (None, f"c {passage} {late}"), (None, late), (7, "x"), (-(2**63), f"{passage}"), (None, f"d {passage[::-1]}"), (None, f"e {passage[::-1]}")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block_bytes in (100, 1 << 20):
        got = substring.substring_digest(table, block_bytes=block_bytes).collect()
        assert key(map(tuple, got)) == key(removed_by_hand(rows, 50))
    with pytest.raises(TypeError):
        substring.substring_digest(table.select(F.col("doc_id").cast("string"), "text"))


def test_substring_rewrites_only_what_loses_words(docs, texts):
    out = substring.remove_repeats(docs, block_bytes=5000)
    assert out.columns == docs.columns and out.count() == docs.count()
    untouched = {(i, t) for (i, t), r in zip(texts, removed_by_hand(texts, 50), strict=True) if not r[2]}
    assert untouched <= {(r["doc_id"], r["text"]) for r in out.collect()}


@pytest.mark.parametrize("piece", [1 << 22, 50])
def test_window_hashes(monkeypatch, piece):
    """Equal where the words are, in any text and piece; words are never cut."""
    monkeypatch.setattr(substring, "PIECE", piece)
    texts = [b"x y z " * 20, b"y\tx\n\nz " * 20, None, b"", b"a\0 a a\0", b"xy z x y z  x y z x" * 3, b"long " * 30 + b"w" * 300]
    for which in (0, 1):
        seen: dict[int, set] = {}
        for first, part in substring.groups(texts):
            w = substring.Words(part, which)
            at, h = w.windows(3)
            for i, x in zip(at.tolist(), h.tolist(), strict=True):
                r = int(w.row[i])
                k = i - int(np.searchsorted(w.row, r))
                seen.setdefault(x, set()).add(b" ".join(words(part[r])[k : k + 3]))
        assert all(len(v) == 1 for v in seen.values())
        assert len(seen) == len({v for s in seen.values() for v in s}) == len({b" ".join(words(t)[k : k + 3]) for t in texts for k in range(len(words(t)) - 2)})


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_word_hashes_in_pieces(piece):
    texts = [b"ab  cd\te" * 9, b"", b"  ", b"x" * 40 + b" y", b"last"]
    got = [(int(r), int(h)) for rows, hs in word_hashes(texts, piece=piece) for r, h in zip(rows, hs, strict=True)]
    name = {}
    assert [r for r, _ in got] == [i for i, t in enumerate(texts) for _ in t.split()]
    assert all(name.setdefault(h, w) == w for (_, h), w in zip(got, (w for t in texts for w in t.split()), strict=True))


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


def test_patterned_words_stay_apart(spark):
    """Words of two letters in a pattern for which any sum of powers modulo 2**64 is the same."""
    one, other = thue_morse(1024)
    shared = " ".join(f"s{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}"), (3, f"{shared} {one}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_digest(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    table = spark.createDataFrame([(1, f"x {one}"), (2, f"x {other}")], "doc_id long, text string")
    known = {r["doc_id"]: r["n_known"] for r in lm_scoring.score_documents(table, F.col("doc_id") == 1).collect()}
    assert known == {1: 3, 2: 2}


def test_windows_of_patterned_words(spark):
    """The same with words for letters, and windows as long."""
    one, other = (" ".join(t) for t in thue_morse(2048))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.substring_digest(docs, width=2048).collect()} == {0}


@pytest.mark.parametrize("which", [0, 1])
def test_span_hashes(which):
    """Every length up to twice that of a long word, zero bytes, and words that differ in one place."""
    base = bytes(range(1, 130))
    texts = [base[:k] for k in range(1, 129)] + [base[:k].replace(b"\x03", b"\x00") for k in range(3, 129)] + [b"\x00" * k for k in range(1, 129)]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    h = common.span_hashes(flat, start, end, which)
    assert len(set(h.tolist())) == len(set(texts))
    assert (common.span_hashes(flat[1:], start[1:] - 1, end[1:] - 1, which) == h[1:]).all()


def test_residues():
    rng = np.random.default_rng(3)
    a, b = (np.append(rng.integers(0, common.PRIME, 500, dtype=np.uint64), np.array([0, 1, common.PRIME - 1], np.uint64)) for _ in "ab")
    assert [int(x) for x in common.product(a, b)] == [int(x) * int(y) % common.PRIME for x, y in zip(a, b, strict=True)]
    v = rng.integers(0, 2**64, 400, dtype=np.uint64)
    want = [sum(int(v[k + j]) * pow(common._BASES[1], j, common.PRIME) for j in range(50)) % common.PRIME for k in range(351)]
    assert common.window_sums(v, np.arange(351), 50, 1).tolist() == want


def test_hot_keys_of_stars(spark, monkeypatch):
    """One member can't stand for a component: spokes are near their hub only, and copies of a spoke aren't near the others."""
    monkeypatch.setattr(simhash, "HOT", 30)
    rng = np.random.default_rng(8)
    hub = rng.integers(0, 2**64, simhash.WORDS, dtype=np.uint64)

    def turned(x, at):
        bits = np.unpackbits(x.view(np.uint8))
        bits[at] ^= 1
        return np.packbits(bits).view(np.uint64)

    order = rng.permutation(256)
    spokes = [turned(hub, order[40 * k : 40 * k + 40]) for k in range(6)]
    wides = [turned(spokes[0], [order[240 + k % 16], order[200 + k // 16]]) for k in range(40)] + spokes + [hub]
    table = spark.createDataFrame([(k, w.tobytes(), np.full(simhash.BANDS, 7, np.int64).tobytes()) for k, w in enumerate(wides)], "body long, wide binary, keys binary")
    edges = [(r["x"], r["y"]) for r in simhash._candidates(table, 0.8, Scratch(spark)).collect()]
    assert (forest(len(wides), np.array([x for x, _ in edges]), np.array([y for _, y in edges])) == 0).all()
