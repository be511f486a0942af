"""What the operators on embeddings share: which vectors take part, samples, codebooks, hot cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that codebooks are fitted on, by order of a hash of the id.
FIT_ROWS = 20_000


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def of_main_length(rows: DataFrame) -> DataFrame:
    """rows (…, v) whose vectors have the most frequent length (the smaller of equally frequent ones)."""
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (top["n"] if top else 0))


def sample(rows: DataFrame, most: int = FIT_ROWS) -> np.ndarray:
    """At most ``most`` vectors of rows (id, v), as doubles."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()
    return np.array([r["v"] for r in got], np.float64)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centroids of Lloyd's algorithm from rows drawn at random; fewer if x has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    rng = np.random.default_rng(seed)
    c = distinct[np.sort(rng.choice(len(distinct), k, replace=False))]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(1, n)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[a : a + 4096], c).argmin(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
