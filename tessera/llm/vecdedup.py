"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own, and a vector lives
in the product cell of its two nearest centroids. Vectors of one group (label) link
where their cosine is at least the threshold, that is where their distance is at most
r with r^2 = 2 - 2 * threshold.

Traversal. For each half and each centroid a lower bound says how far a vector must
move before that centroid becomes its nearest (the greatest distance to a bisector). A
multi-sequence walk visits product cells by ascending sum of the squared bounds and ends
at the sum within which ``TARGET`` of the links lie. That sum is measured twice, and the
larger one holds. On links: ``PROBES`` vectors are compared with all others, and the sums that
either end of their links needs are ordered, the links of a vector weighing one together. On
moves: vectors of the sample (``TRIALS`` of them) are moved in random directions to just the
threshold, and the sums of the cells where they arrive are ordered. No sum exceeds r^2, from
where on no cell can hold a link.

Verification multiplies visitors by members in blocks and measures the cosine in double
precision; cosines within rounding of the threshold are summed again pair by pair, so both
ends see the same. A pair that one end finds counts for both: a member whose own walk doesn't
lead to the visitor's cell (each row carries the cells of its walk) is credited with the
visitor's link. Links aren't written out: a block returns numbers of links and a spanning
forest, at most one edge a vector. Equal vectors are collapsed first and counted by their number.

Cells with many members or visitors are split into blocks of ``SIDE`` by ``SIDE``.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, one without label, and one of another length than most link with nothing:
n_links 0, a component of its own; repeated rows link with each other; rows without id
are counted as partners and keep a null component if they have no partner with an id;
an empty table gives an empty result. Only id, vector and label are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.components import components, forest
from tessera.llm.vectors import codebook, nearest, of_main_length, sample, squared, usable

#: Vectors for one product cell, on average, and the most centroids of a half.
CELL_ROWS, MAX_HALF = 2048, 512
SIDE = 4096
#: Share of links at exactly the threshold whose cells are visited, and the vectors that this is measured on.
TARGET, TRIALS = 0.9995, 8000
#: Vectors whose links are all looked up to measure the walk, and the steps in which sums are counted.
PROBES, STEPS = 2000, 4096


def reach_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row and centroid: the least distance to a point whose nearest centroid that is."""
    d = squared(x, c)
    gap = 2 * np.sqrt(squared(c, c))
    np.fill_diagonal(gap, np.inf)
    out = np.zeros_like(d)
    for k in range(len(c)):
        out[:, k] = np.maximum(0, ((d[:, k : k + 1] - d) / np.where(gap[k] > 0, gap[k], np.inf)).max(axis=1))
    return out


def walk(left: np.ndarray, right: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Product cells by ascending left^2 + right^2, while that is at most ``most``."""
    a, b = left.argsort(kind="stable"), right.argsort(kind="stable")
    l2, r2 = left[a] ** 2, right[b] ** 2
    heap, out = [(l2[0] + r2[0], 0, 0)], []
    while heap and heap[0][0] <= most:
        s, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (l2[i] + r2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (l2[i + 1] + r2[0], i + 1, 0))
    return out


def walk_limit(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, target: float, seed: int = 6) -> float:
    """The sum of squared bounds up to which cells are visited. x: unit vectors."""
    x = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
    most = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    if target >= 1:
        return most
    step = np.random.default_rng(seed).normal(size=x.shape)
    step -= (step * x).sum(axis=1)[:, None] * x
    size = np.sqrt((step**2).sum(axis=1))[:, None]
    y = threshold * x + math.sqrt(1 - threshold**2) * np.divide(step, size, out=np.zeros_like(step), where=size > 1e-12)
    half = left.shape[1]
    rows = np.arange(len(x))
    sums = reach_bounds(x[:, :half], left)[rows, nearest(y[:, :half], left)] ** 2 + reach_bounds(x[:, half:], right)[rows, nearest(y[:, half:], right)] ** 2
    return min(most, float(np.quantile(sums, target, method="higher")))


def _unit(vectors: pd.Series) -> np.ndarray:
    u = np.array(vectors.tolist(), np.float64)
    return u / np.sqrt((u**2).sum(axis=1))[:, None]


def linked_limit(rows: DataFrame, left: np.ndarray, right: np.ndarray, threshold: float, target: float) -> float:
    """The sum of squared bounds within which ``target`` of the links of PROBES of the rows (label, id, v) lie, seen from either end; 0 if they have none."""
    asked = rows.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("label", "id", "v").toPandas()
    most, half = 2 - 2 * threshold, left.shape[1]
    s = _unit(asked["v"])
    ids, labels = asked["id"].to_numpy(np.int64), asked["label"].to_numpy()
    bounds = [reach_bounds(s[:, :half], left), reach_bounds(s[:, half:], right)]
    homes = [nearest(s[:, :half], left), nearest(s[:, half:], right)]

    def probe(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 2048):
                part = pdf[a : a + 2048]
                u = _unit(part["v"])
                near = (u @ s.T >= threshold) & (part["id"].to_numpy()[:, None] != ids) & (part["label"].to_numpy()[:, None] == labels)
                y, q = np.nonzero(near)
                if not len(y):
                    continue
                some, at = np.unique(y, return_inverse=True)
                u = u[some]
                there = bounds[0][q, nearest(u[:, :half], left)[at]] ** 2 + bounds[1][q, nearest(u[:, half:], right)[at]] ** 2
                back = reach_bounds(u[:, :half], left)[at, homes[0][q]] ** 2 + reach_bounds(u[:, half:], right)[at, homes[1][q]] ** 2
                step = np.minimum(np.ceil(np.minimum(there, back) / most * STEPS), STEPS).astype(np.int64)
                pairs, times = np.unique(q * (STEPS + 1) + step, return_counts=True)
                yield pd.DataFrame({"q": pairs // (STEPS + 1), "step": pairs % (STEPS + 1), "times": times})

    found = rows.select("label", "id", "v").mapInPandas(probe, "q long, step long, times long").groupBy("q", "step").agg(F.sum("times").alias("times"))
    share = F.col("times") / F.sum("times").over(W.partitionBy("q"))
    steps = sorted(found.withColumn("share", share).groupBy("step").agg(F.sum("share").alias("share")).collect())
    total, sum_ = sum(r["share"] for r in steps), 0.0
    for r in steps:
        sum_ += r["share"]
        if sum_ >= target * total - 1e-9:
            return r["step"] / STEPS * most
    return 0.0


def _compare(threshold: float):
    def f(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"id": [], "links": [], "other": []})
        x, y = (np.array(d["v"].tolist(), np.float64) for d in (asked, held))
        i, j = asked["id"].to_numpy(np.int64), held["id"].to_numpy(np.int64)
        weigh_x, weigh_y = asked["times"].to_numpy(np.int64), held["times"].to_numpy(np.int64)
        nx, ny = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
        names = np.union1d(i, j)
        at_i, at_j = np.searchsorted(names, i), np.searchsorted(names, j)
        links, back, root = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64), np.arange(len(names))
        # the members' walks as sorted (member, cell) numbers
        homes, home = np.unique(asked["home"].to_numpy(np.int64), return_inverse=True)
        of = np.repeat(np.arange(len(j)), [len(v) for v in held["visits"]])
        cells = np.concatenate(held["visits"].tolist())
        place = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
        known = homes[place] == cells
        walks = np.unique(of[known] * len(homes) + place[known])
        for a in range(0, len(x), 512):
            cosine = (x[a : a + 512] @ y.T) / (nx[a : a + 512, None] * ny)
            near = cosine >= threshold
            p, q = np.nonzero(np.abs(cosine - threshold) < 1e-9)
            if len(p):
                near[p, q] = (x[a + p] * y[q]).sum(axis=1) / (nx[a + p] * ny[q]) >= threshold
            near &= i[a : a + 512, None] != j
            p, q = np.nonzero(near)
            if len(p):
                links[a : a + 512] = near @ weigh_y
                some, where = np.unique(home[a : a + 512], return_inverse=True)
                asks = np.arange(len(j)) * len(homes) + some[:, None]
                comes = walks[np.minimum(np.searchsorted(walks, asks), len(walks) - 1)] == asks if len(walks) else np.zeros(asks.shape, bool)
                back += weigh_x[a : a + 512] @ (near & ~comes[where])
                root = forest(len(names), np.concatenate([np.arange(len(names)), at_i[a + p]]), np.concatenate([root, at_j[q]]))
        out = pd.DataFrame({"id": i, "links": links, "other": names[root[at_i]]})
        more = names[root[at_j]]  # members that no visitor's row stands for
        rest = pd.DataFrame({"id": j, "links": back, "other": more})
        return pd.concat([out[out["links"] > 0], rest[(back > 0) | (more != j)]])

    return f


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    scratch = Scratch(rows.sparkSession)
    base = scratch.table(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(group_col).cast("string").alias("label")))
    fit = of_main_length(base.where(F.col("label").isNotNull() & usable(F.col("v"))))
    # copies: counted before the shuffle, so one vector in a third of all rows is one row a task
    counted = fit.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("times"))
    # within, a vector goes by a number of its own, fixed by being written; ids may repeat, be negative or missing
    distinct = scratch.table(counted.withColumn("id", F.monotonically_increasing_id()))
    n = distinct.count()
    alone = base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    x = sample(distinct.select("id", "v"))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    half = x.shape[1] // 2
    size = max(1, min(MAX_HALF, math.ceil(math.sqrt(n / CELL_ROWS)) + 1))
    left, right = codebook(x[:, :half], size) if half else np.zeros((1, 0)), codebook(x[:, half:], size)
    most = walk_limit(x, left, right, threshold, target)
    if target < 1:
        most = max(most, linked_limit(distinct, left, right, threshold, target))

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                u = _unit(pdf["v"])
                cell = nearest(u[:, :half], left) * len(right) + nearest(u[:, half:], right)
                bounds = zip(reach_bounds(u[:, :half], left), reach_bounds(u[:, half:], right), strict=True)
                yield pdf.assign(cell=cell, visits=[[i * len(right) + j for i, j in walk(p, q, most)] for p, q in bounds])

    held = scratch.table(distinct.select("label", "id", "v", "times").mapInPandas(placed, "label string, id long, v array<double>, times long, cell long, visits array<long>"))
    asked = held.select(*(F.col(c).alias(c) for c in ("label", "id", "v", "times")), F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    key = ["label", "cell"]
    blocks = held.groupBy(*key).agg(F.ceil(F.count("*") / SIDE).alias("ys")).join(asked.groupBy(*key).agg(F.ceil(F.count("*") / SIDE).alias("xs")), key)
    blocks = scratch.table(blocks)
    where = F.xxhash64("id")
    q = asked.join(blocks, key).withColumn("x", F.pmod(where, F.col("xs"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)))
    m = held.join(blocks, key).withColumn("y", F.pmod(where, F.col("ys"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)))
    parts = ["label", "cell", "x", "y"]
    asks, holds = q.select(*parts, "id", "v", "times", "home"), m.select(*parts, "id", "v", "times", "visits")
    seen = asks.groupBy(*parts).cogroup(holds.groupBy(*parts)).applyInPandas(_compare(threshold), "id long, links long, other long")
    seen = scratch.table(seen)
    counted = seen.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(seen.where("id <> other").select(F.col("id").alias("x"), F.col("other").alias("y")), scratch)
    told = distinct.join(counted, "id", "left").join(roots, distinct["id"] == roots["node"], "left")
    told = scratch.table(told.select(F.col("label").alias("g"), F.col("v").alias("w"), "low", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("root", "id").alias("root")))
    named = told.groupBy("root").agg(F.min("low").alias("component"))
    told = told.join(named, "root").select("g", "w", "links", "component")
    out = base.join(told, (base["label"] == told["g"]) & (base["v"] == told["w"]), "left")
    root = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))
