"""Operators on embeddings and urls against brute force, with odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, url_filter, vecdedup, vectors
from tessera.llm.queries import RULES

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v int, cell string, links int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    out = []
    for i in range(300):
        x = base[i % 60] + rng.normal(scale=0.08, size=8)
        out.append((i, [float(np.float32(c)) for c in x], i % 3))
    out += [(400 + k, out[5][1], out[5][2]) for k in range(5)] + [out[7], out[7]]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 7 + [None], [1.0] * 5]
    # negative and repeated ids, and the largest and smallest longs
    strange = [(-5, out[20][1], out[20][2]), (2**63 - 1, out[20][1], out[20][2]), (-(2**63), out[33][1], out[33][2]), (21, out[44][1], out[44][2])]
    return out + strange + [(500 + k, v, 0) for k, v in enumerate(odd)] + [(600, out[9][1], None), (None, out[11][1], out[11][2])]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], SCHEMA).repartition(3)


def takes_part(v):
    return v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("side", [4096, 16])
def test_near_vectors(table, rows, monkeypatch, side):
    monkeypatch.setattr(vecdedup, "SIDE", side)
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 20)
    got = vecdedup.near_vectors(table, target=1.0).collect()
    ok = [k for k, (_, v, g) in enumerate(rows) if takes_part(v) and g is not None]
    x = np.array([rows[k][1] for k in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (np.array([rows[k][2] for k in ok])[:, None] == np.array([rows[k][2] for k in ok]))
    np.fill_diagonal(near, False)
    root = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.array([min([root[k], *root[near[k]]]) for k in range(len(ok))])
        if (new == root).all():
            break
        root = new
    links = {k: 0 for k in range(len(rows))} | {k: int(near[j].sum()) for j, k in enumerate(ok)}
    low = {k: rows[k][0] for k in range(len(rows))}
    for j, k in enumerate(ok):
        ids = [rows[ok[m]][0] for m in np.flatnonzero(root == root[j]) if rows[ok[m]][0] is not None]
        low[k] = min(ids, default=None)
    want = [(rows[k][0], links[k], low[k], rows[k][0] == low[k] if rows[k][0] is not None else None) for k in range(len(rows))]
    order = lambda rs: sorted(rs, key=repr)
    assert order((r[0], r[1], r[2]) for r in got) == order(w[:3] for w in want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_near_vectors_reach_their_target(spark, monkeypatch):
    """Links of clustered vectors found by the measured walk, against brute force, and the cells it spares."""
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    x = centres[rng.integers(0, 150, 1500)] + rng.normal(scale=0.1, size=(1500, 32))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_vectors(table).collect()}
    assert near.sum() > 5000 and sum(got.values()) >= 0.995 * near.sum()
    assert all(got[i] <= near[i].sum() for i in got)
    left, right = (vectors.codebook(h, 14) for h in (unit[:, :16], unit[:, 16:]))
    bounds = [vecdedup.reach_bounds(h, c) for h, c in ((unit[:, :16], left), (unit[:, 16:], right))]
    visits = lambda most: sum(len(vecdedup.walk(a, b, most)) for a, b in zip(*bounds, strict=True))
    assert visits(vecdedup.walk_limit(unit, left, right, 0.98, vecdedup.TARGET)) < 0.5 * visits(vecdedup.walk_limit(unit, left, right, 0.98, 1.0))


def test_near_vectors_empty(spark):
    assert vecdedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    c = vectors.codebook(x, 6)
    bound, at = vecdedup.reach_bounds(x, c), vectors.nearest(x, c)
    far = np.sqrt(vectors.squared(x, x))
    assert (bound[:, at] <= far + 1e-6).all()
    cells = vecdedup.walk(bound[0], bound[1], 0.5)
    sums = [bound[0][i] ** 2 + bound[1][j] ** 2 for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (bound[0][:, None] ** 2 + bound[1] ** 2 <= 0.5).sum()


def test_neighbours(table, rows):
    """Repeated rows, an id of two vectors, negative ids and odd vectors; against brute force."""
    got = ann.search(table, F.col("vec_id") % 10 == 0).toPandas()
    ok: dict[int, list[np.ndarray]] = {}
    for i, v, _ in rows:
        if i is not None and takes_part(v):
            ok.setdefault(i, []).append(np.array(v, float))
    far = lambda a, b: min(float(np.sqrt(((x - y) ** 2).sum())) for x in ok[a] for y in ok[b])
    asked = {i for i in ok if i % 10 == 0 and i > -(2**63)}
    assert set(got.query_id) == asked
    hits = total = 0
    for q in asked:
        best = sorted((far(q, i), i) for i in ok if i != q)[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and q not in set(mine.vec_id)
        assert all(abs(s - far(q, i)) < 1e-9 for s, i in zip(mine.score, mine.vec_id, strict=True))
        hits += len({i for _, i in best} & set(mine.vec_id))
        total += 10
    assert hits / total >= 0.9


def test_shortlists_decide_by_codes(spark, monkeypatch):
    """With a short shortlist the codes choose what is measured, over all visited cells of a query."""
    monkeypatch.setattr(ann, "SHORTLIST", 25)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 4000)] + rng.normal(scale=0.3, size=(4000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 400 and hits / 400 >= 0.9


def test_neighbours_of_vectors_of_many_lengths(spark):
    """Lengths from thousandths to thousands: codes fitted on long vectors hardly tell short ones apart."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12_000, 64)) * np.exp(rng.normal(size=(12_000, 1)) * 3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q in range(0, 12_000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 1200 and hits / 1200 >= 0.9


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0], 0, 0, 0, "", 0) for i in range(4)], SCHEMA)
    got = ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0
    assert ann.search(few.limit(1), F.lit(True)).count() == 0


def test_neighbours_among_copies(spark):
    """Of more equal vectors than a shortlist holds the smallest ids; an id of many rows takes one place."""
    rng = np.random.default_rng(4)
    ids = rng.permutation(np.arange(1, 401)).tolist()
    rows = [(i, [1.0, 2.0, 3.0]) for i in ids] + [(0, [1.0, 2.0, 3.5])]
    rows += [(1000, [9.0, 9.0 + j / 1000, 9.0]) for j in range(150)] + [(1001, [9.0, 9.0, 9.0])] + [(1002 + j, [9.0, 10.0 + j, 9.0]) for j in range(12)]
    table = spark.createDataFrame([(i, v, 0, 0, 0, "", 0) for i, v in rows], SCHEMA)
    got = ann.search(table, F.col("vec_id").isin(0, 5, 1001), target=1.0).orderBy("query_id", "rank").collect()
    found = lambda q: [r["vec_id"] for r in got if r["query_id"] == q]
    assert found(0) == list(range(1, 11))
    assert found(5) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert found(1001)[0] == 1000 and len(set(found(1001))) == 10


URLS = [
    (1, "http://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "https://Example.NET/de", "example.net", "/de", "net/", "block"),
    (3, "http://example.net?x=/en/", "example.net", "", None, "allow"),
    (4, "http://www.x.org/fr/1#casino", "www.x.org", "/fr/1", "org/fr/", "allow"),
    (5, "http://x.com/casino", "x.com", "/casino", None, "block"),
    (6, "http://x.com/casinos", "x.com", "/casinos", None, "allow"),
    (7, "http://x.com/poker", "x.com", "/poker", None, "allow"),
    (8, "http://poker.com/free-poker", "poker.com", "/free-poker", None, "block"),
    (81, "http://x.com/win/offer", "x.com", "/win/offer", None, "allow"),
    (82, "http://x.com/win/offer?sale", "x.com", "/win/offer", None, "block"),
    (83, "http://x.com/poker-poker_poker", "x.com", "/poker-poker_poker", None, "allow"),
    (84, "http://x.com/" + "a" * 100_000 + "/free/bets", "x.com", "/" + "a" * 100_000 + "/free/bets", None, "block"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme/xxx", "", "", None, "block"),
    (11, "", "", "", None, "allow"),
    (None, "http://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
    (None, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
]


def test_urls(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u, *_ in URLS], "page_id long, url string, host string, html string")
    got = url_filter.judge_urls(table, RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *r) for i, _, *r in URLS], key=repr)
    assert url_filter.judge_urls(table.limit(0), RULES).count() == 0


def test_url_terms_from_a_file(spark, tmp_path):
    file = tmp_path / "terms.txt"
    file.write_text("# ours\nBad 100\n\nso 60\nlala 40\nla 40\n")
    terms = url_filter.read_terms(file)
    assert terms == {"bad": 100, "so": 60, "lala": 40, "la": 40}
    urls = ["http://so.la/", "http://lala.la/", "http://solala/", "http://x/BAD", "http://so.so/"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(table, [], terms).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow"}
    assert len(url_filter.read_terms()) > 90


def links_by_hand(x, threshold=0.98):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("axis", [None, 0, 21])
def test_links_count_for_both_ends(spark, monkeypatch, axis):
    """Pairs at just the threshold, moved any way or along one coordinate, over many cells: as many links as by hand, and none on one side only."""
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 8)
    rng = np.random.default_rng(11)
    n, dims = 1500, 32
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rng.normal(size=(n, dims)) if axis is None else np.repeat(np.eye(dims)[axis][None], n, axis=0)
    step -= (step * x).sum(axis=1)[:, None] * x
    step /= np.linalg.norm(step, axis=1)[:, None]
    c = 0.98001
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * step])
    near = links_by_hand(both)
    assert near.sum() >= 2 * n
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.near_vectors(table).collect()}
    assert sum(k for k, _ in got.values()) >= 0.99 * near.sum()
    # a link is told of at both ends: components of two rows hold one link each, and no row without links shares a component
    size = Counter(c for _, c in got.values())
    for i, (k, c) in got.items():
        assert k <= near[i].sum() and (k > 0) == (size[c] > 1) and (size[c] != 2 or k == 1)


def test_crowd_of_near_copies(spark, monkeypatch):
    """One crowd over several cells and blocks, with weights: links are those by hand."""
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 8)
    monkeypatch.setattr(vecdedup, "SIDE", 50)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(1, 16)), 700, axis=0) + rng.normal(scale=0.11, size=(700, 16))
    x[600:] = x[:100]
    near = links_by_hand(x)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_vectors(table, target=1.0).collect()}
    assert got == {i: int(near[i].sum()) for i in range(len(x))}
    found = {r["vec_id"]: r["n_links"] for r in vecdedup.near_vectors(table).collect()}
    assert sum(found.values()) >= 0.999 * near.sum() and all(found[i] <= got[i] for i in got)


@pytest.mark.parametrize("rows", [3_000, 6_000])
def test_bounds_hold_a_shortlist_and_little_more(rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(rows, 16))
    index = ann.Index(x[:3_000], rows)
    every = index.decode(*index.encode(x))
    far = ((every[None] - index.moved(x[:40])[:, None]) ** 2).sum(axis=2)
    inside = (far <= ann.bounds(index, every[:3_000], x[:40], 100, rows)[:, None]).sum(axis=1)
    assert (inside >= 101).all() and (inside <= 300).all()
    assert np.isinf(ann.bounds(index, every[:5], x[:2], 100, rows)).all()


def test_bounded_lists_hold_the_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6_000, 32))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 100 == 0).toPandas()
    far = np.sqrt(((x[None, ::100] - x[:, None]) ** 2).sum(axis=2)).T
    far[np.arange(60), np.arange(60) * 100] = np.inf
    want = {(q * 100, int(v)) for q in range(60) for v in np.argsort(far[q])[:10]}
    assert len(got) == 600 and len(want & set(zip(got["query_id"], got["vec_id"], strict=True))) >= 540
