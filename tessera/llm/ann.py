"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample (``vectors.FIT_ROWS``) and holds every row: its
coarse cell and the codes of its residual, one byte for each of ``PARTS`` sub-vectors.
How many cells a query visits and how long its shortlist is are measured, on ``TRIALS`` of
the queries themselves, whose true neighbours among all rows are found by brute force in two
bounded passes: the number of visits is that whose cells hold ``TARGET`` of those neighbours,
the length of the shortlist that within which ``KEPT`` of them come by their codes. So rows
that codes can't tell apart (tight clusters, lengths of many sizes) get longer shortlists
rather than fewer of their neighbours. A query visits its nearest cells and ranks their
ids by asymmetric distance tables (the query's residual against all codewords, summed by
code). Each cell hands on as many as ``DEEP`` of those neighbours need, and none that lies beyond the
query's bound: the distance, by codes, within which the sample alone shows that a whole shortlist lies. So
what is handed on in all is in proportion to the shortlists, however many cells are visited. The best ids of all cells
together, ``SHORTLIST`` at least, and all that tie with
the last of them, are measured exactly, in double precision on the original vectors. Only
codes go to the lists; vectors are met again for the shortlists. Distances to centroids are
taken from the sample's median, so that a common offset doesn't eat their digits.

Of the ids of equal vectors the smallest ``k + 1`` are indexed: a larger id has ``k`` others
ahead of it in every query. An id of several rows counts once, by its nearest; the query's
own id is left out before any cut.

Lists longer than ``LIST_ROWS`` are split by a hash of the id, and the queries that
visit them go to every part. Only the cells' sizes (as many rows as centroids, a fixed
bound) reach the driver. What is shuffled is the codes, the visits, and the index once.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without id or with another length than most; rows
that share the query's id are the query's own; repeated rows of a candidate count once;
ties go to the smaller id; fewer candidates than asked for are all returned; an empty
table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.vectors import codebook, of_main_length, sample, squared, usable

PARTS = 32
CODES = 256
#: Ids of a query that are measured exactly, at least.
SHORTLIST = 100
LIST_ROWS = 16_384
MAX_CELLS = 4096
#: Shares of true neighbours whose cells are visited, that come into the shortlist and that their cell hands on, and the queries that this is measured on.
TARGET, KEPT, DEEP, TRIALS = 0.97, 0.97, 0.99, 128


class Index:
    """Coarse centroids and, for each part of the residual, its codewords."""

    def __init__(self, x: np.ndarray, rows: int, parts: int = PARTS):
        dim = x.shape[1]
        self.origin = np.median(x, axis=0)
        x = self.moved(x)
        self.coarse = codebook(x, max(1, min(MAX_CELLS, math.isqrt(rows), len(x) // 8 or 1)))
        cell = squared(x, self.coarse).argmin(axis=1)
        left = x - self.coarse[cell]
        self.cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        self.words = [codebook(left[:, a:b], CODES, 8) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def moved(self, x: np.ndarray) -> np.ndarray:
        return x - self.origin

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.moved(x)
        cell = squared(x, self.coarse).argmin(axis=1)
        left = x - self.coarse[cell]
        codes = [squared(left[:, a:b], w).argmin(axis=1) for a, b, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for, as ``moved`` vectors."""
        return self.coarse[cell] + np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """For each row of x all cells, nearest first."""
        return squared(self.moved(x), self.coarse).argsort(axis=1, kind="stable")

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the parts of q's residual to all codewords."""
        left = self.moved(q) - self.coarse[cell]
        out = np.full((len(self.words), CODES), np.inf)
        for m, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words, strict=False)):
            out[m, : len(w)] = ((left[a:b] - w) ** 2).sum(axis=1)
        return out


def bounds(index: Index, decoded: np.ndarray, x: np.ndarray, shortlist: int, rows: int) -> np.ndarray:
    """For each row of x the squared distance, by codes, within which some ``shortlist`` of the index's rows lie at least.

    decoded: what the codes of an even sample of the rows stand for. If it is all of them, the bound is that of the
    shortlist and one id more (the query's own); else four standard deviations are put on top of the rank.
    """
    rank = (shortlist + 1) * len(decoded) / max(1, rows)
    rank = math.ceil(rank if len(decoded) >= rows else rank + 4 * math.sqrt(rank) + 4)
    if rank >= len(decoded):
        return np.full(len(x), np.inf)
    moved = index.moved(x)
    return np.array([np.partition(((decoded - q) ** 2).sum(axis=1), rank)[rank] for q in moved]) * (1 + 1e-6)


def measured(index: Index, stored: DataFrame, asking: DataFrame, k: int, target: float) -> tuple[int, int, int]:
    """How many cells a query must visit, how many ids each must hand on and how many must be measured, for the given share of its true neighbours.

    stored: (cell, id, v, codes) of all rows; asking: (id, v). At most ``TRIALS`` queries meet all rows; tasks pass on
    at most k rows a query, and then one count a neighbour.
    """
    trials = asking.orderBy(F.xxhash64("id", "v"), "id").limit(TRIALS).collect()
    own, q = np.array([r["id"] for r in trials], np.int64), np.array([r["v"] for r in trials], np.float64)

    def nearest_of(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = np.array(pdf["v"].tolist(), np.float64), pdf["id"].to_numpy(np.int64)
            for t in range(len(q)):
                far = ((x - q[t]) ** 2).sum(axis=1)
                far[ids == own[t]] = np.inf
                best = np.argpartition(far, k - 1)[:k] if len(far) > k else np.arange(len(far))
                best = best[far[best] < np.inf]
                yield pd.DataFrame({"t": t, "far": far[best], "id": ids[best], "cell": pdf["cell"].to_numpy()[best], "codes": pdf["codes"].to_numpy()[best]})

    best = stored.mapInPandas(nearest_of, "t int, far double, id long, cell long, codes binary")
    place = F.row_number().over(Window.partitionBy("t").orderBy("far", "id"))
    found = best.withColumn("place", place).where(F.col("place") <= k).select("t", "cell", "codes").collect()
    if not found:
        return len(index.coarse), SHORTLIST, SHORTLIST
    t, cell = np.array([r["t"] for r in found]), np.array([r["cell"] for r in found])
    codes = np.frombuffer(b"".join(bytes(r["codes"]) for r in found), np.uint8).reshape(len(found), -1)
    ranks = index.order(q).argsort(axis=1)[t, cell]
    probes = int(np.quantile(ranks, target, method="higher")) + 1
    moved = index.moved(q)
    rough = ((index.decode(cell, codes) - moved[t]) ** 2).sum(axis=1) * (1 - 1e-9)

    def ahead_of(batches):
        ahead, inside = np.zeros(len(rough), np.int64), np.zeros(len(rough), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            x = index.decode(pdf["cell"].to_numpy(), np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(len(pdf), -1))
            at = pdf["cell"].to_numpy()
            for j in np.unique(t):
                far, mine = ((x - moved[j]) ** 2).sum(axis=1), np.flatnonzero(t == j)
                ahead[mine] += np.searchsorted(np.sort(far), rough[mine], side="left")
                for m in mine:
                    inside[m] += (far[at == cell[m]] < rough[m]).sum()
        yield pd.DataFrame({"n": np.arange(len(ahead)), "ahead": ahead, "inside": inside})

    counted = stored.select("cell", "codes").mapInPandas(ahead_of, "n int, ahead long, inside long").groupBy("n").agg(F.sum("ahead").alias("ahead"), F.sum("inside").alias("inside")).collect()
    short = max(SHORTLIST, int(np.quantile([r["ahead"] for r in counted], KEPT, method="higher")) + 1)
    deep = max(2 * k, int(np.quantile([r["inside"] for r in counted], DEEP, method="higher")) + 1)
    return min(len(index.coarse), probes), min(deep, short), short


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest among all others."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    none = "query_id long, rank int, vec_id long, score double"
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = of_main_length(base.where(F.col("id").isNotNull() & usable(F.col("v"))))
    least = lambda ids: F.slice(F.sort_array(ids), 1, k + 1)
    salted = base.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(least(F.collect_set("id")).alias("ids"))
    alike = scratch.table(salted.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.explode("ids").alias("id"), "v"))
    n = alike.count()
    if not n:
        return spark.createDataFrame([], none)
    fitted = sample(alike)
    index = Index(fitted, n)
    decoded = index.decode(*index.encode(fitted))
    cells = len(index.coarse)

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                cell, codes = index.encode(np.array(pdf["v"].tolist(), np.float64))
                yield pd.DataFrame({"cell": cell, "id": pdf["id"], "v": pdf["v"], "codes": [c.tobytes() for c in codes]})

    stored = scratch.table(alike.mapInPandas(encode, "cell long, id long, v array<double>, codes binary"))
    sizes, fresh = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for cell, count in stored.groupBy("cell").count().collect():
        sizes[cell] = count
    # an id with several vectors counts in one cell only
    for cell, count in stored.groupBy("id").agg(F.min("cell").alias("cell")).groupBy("cell").count().collect():
        fresh[cell] = count
    single = fresh.sum() == sizes.sum()  # else many rows within a bound may be few ids
    split = np.maximum(1, -(-sizes // LIST_ROWS))
    asking = scratch.table(base.where("asks").select("id", "v").distinct())
    probes, deep, shortlist = measured(index, stored, asking, k, target)

    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["v"].tolist(), np.float64)
            out = []
            upper = bounds(index, decoded, x, shortlist, n) if single else np.full(len(x), np.inf)
            for i, v, cs, far in zip(pdf["id"], pdf["v"], index.order(x), upper, strict=True):
                held = np.cumsum(fresh[cs])  # enough cells to hold k others, however small they are
                upto = max(probes, int(np.searchsorted(held, min(held[-1], 20 * k + 1))) + 1)
                near = int(np.searchsorted(held, min(held[-1], k + 1))) + 1  # these hand on whatever the bound, so that k are found
                out += [(c, part, i, v, far if at >= near else np.inf) for at, c in enumerate(cs[:upto].tolist()) if sizes[c] for part in range(split[c])]
            yield pd.DataFrame(out, columns=["cell", "part", "id", "v", "far"])

    visits = asking.mapInPandas(visit, "cell long, part long, id long, v array<double>, far double")

    def part_of(batches):
        for pdf in batches:
            if len(pdf):
                h = (pdf["id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield pdf.assign(part=(h % split[pdf["cell"].to_numpy()].astype(np.uint64)).astype(np.int64))

    lists = stored.select("cell", "id", "codes").mapInPandas(part_of, "cell long, id long, codes binary, part long")

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        queries, names, roughs = [], [], []
        if len(asked) and len(held):
            cell = int(held["cell"].iloc[0])
            codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1)
            names_of, at = np.unique(held["id"].to_numpy(np.int64), return_inverse=True)
            parts = np.arange(codes.shape[1])
            for i, v, far in zip(asked["id"].tolist(), np.array(asked["v"].tolist(), np.float64), asked["far"].tolist(), strict=True):
                rough = np.full(len(names_of), np.inf)
                np.minimum.at(rough, at, index.tables(v, cell)[parts, codes].sum(axis=1))
                rough[names_of == i] = np.inf
                last = np.partition(rough, deep - 1)[deep - 1] if len(rough) > deep else np.inf
                best = np.flatnonzero((rough <= min(last, far)) & (rough < np.inf))
                queries.append(np.full(len(best), i))
                names.append(names_of[best])
                roughs.append(rough[best])
        join = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        return pd.DataFrame({"query_id": join(queries, np.int64), "vec_id": join(names, np.int64), "rough": join(roughs, float)})

    found = visits.groupBy("cell", "part").cogroup(lists.groupBy("cell", "part")).applyInPandas(look, "query_id long, vec_id long, rough double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("rough").alias("rough"))
    by_code = Window.partitionBy("query_id").orderBy("rough")
    short = found.withColumn("place", F.rank().over(by_code)).where(F.col("place") <= shortlist).select("query_id", "vec_id")
    near = short.join(stored.select(F.col("id").alias("vec_id"), F.col("v").alias("w")), "vec_id").join(asking.select(F.col("id").alias("query_id"), "v"), "query_id")
    gap = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    exact = near.groupBy("query_id", "vec_id").agg(F.min(F.sqrt(gap)).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
