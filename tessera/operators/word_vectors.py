"""Word vectors from co-occurrence, and likeness of findings by them.

Words that stand within a window of each other in a sentence are counted; the table of positive
pointwise mutual information (PPMI) of their pairs is symmetric, and a randomised range finder
gives its leading eigenvectors: a random start, products with the table, orthonormalised in
between. A product is a join by blocks of words, so neither the table nor the vectors are ever
in one place; only matrices as wide as the vectors are long go through the driver. A vector is a
row of the eigenvectors, scaled by the roots of the eigenvalues' sizes.

A text's vector is the mean of the vectors of its known tokens. Two texts are as alike as the
cosine of theirs; where that exceeds one half and the texts name sides in different order, it
loses 0.05. A text without known tokens is like nothing (0).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.automaton import sent
from tessera.operators.vocabulary import Lattice
from tessera.scratch import stored

WINDOW = 5
#: Length of vectors, additional columns of the range finder, and its products.
DIMS, EXTRA, ROUNDS = 32, 16, 4
#: Words of one block of a product, on average, and the most words that have vectors (they are sent to the tasks).
BLOCK, MOST = 20_000, 200_000
#: The least cosine from which sides count, and what differing ones cost.
SIDES_FROM, SIDES_COST = 0.5, 0.05


def cooccurrences(rows: DataFrame, window: int = WINDOW, tokens: str = "tokens") -> DataFrame:
    """(a, b, n): ordered pairs of tokens at most ``window`` places apart in a row, both ways round."""
    each = rows.groupBy(F.col(tokens).alias("t")).agg(F.count("*").alias("times")).where(F.size("t") > 1)
    t, size = F.col("t"), F.size("t")
    near = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(window), size - i)), lambda d: F.struct(F.get(t, i - 1).alias("a"), F.get(t, i + d - 1).alias("b")))
    pairs = each.select("times", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), near))).alias("p")).groupBy("p.a", "p.b").agg(F.sum("times").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(a, b, x): the positive pointwise mutual information of (a, b, n), where it isn't zero. pairs: both ways round."""
    pairs = stored(pairs)
    each = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    total = each.agg(F.sum("na")).first()[0] or 0
    of_b = each.select(F.col("a").alias("b"), F.col("na").alias("nb"))
    x = F.ln(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb").cast("double")))
    return pairs.join(each, "a").join(of_b, "b").select("a", "b", x.alias("x")).where("x > 1e-12")


def _block(word: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(blocks)).alias("block")


def _start(seeds: np.ndarray, width: int) -> np.ndarray:
    """Random signs, fixed by the seeds."""
    z = seeds[:, None].view(np.uint64) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where((z ^ (z >> np.uint64(31))) >> np.uint64(63), 1.0, -1.0)


def _product(table: DataFrame, dense: DataFrame, blocks: int) -> DataFrame:
    """The rows (word, y) of table (a, b, x, block of b) times dense (word, y, block)."""
    def part(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(rows):
            return pd.DataFrame({"word": [], "y": []})
        names, at = np.unique(entries["a"].to_numpy(str), return_inverse=True)
        order = np.argsort(rows["word"].to_numpy(str))
        y = np.array(rows["y"].tolist())[order]
        b = np.searchsorted(rows["word"].to_numpy(str)[order], entries["b"].to_numpy(str))
        x, out = entries["x"].to_numpy(), np.zeros((len(names), y.shape[1]))
        for k in range(0, len(x), 1 << 16):
            np.add.at(out, at[k : k + (1 << 16)], x[k : k + (1 << 16), None] * y[b[k : k + (1 << 16)]])
        return pd.DataFrame({"word": names, "y": list(out)})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(rows["word"].to_numpy(str), return_inverse=True)
        y = np.array(rows["y"].tolist())
        out = np.zeros((len(names), y.shape[1]))
        np.add.at(out, at, y)
        return pd.DataFrame({"word": names, "y": list(out)})

    schema = "word string, y array<double>"
    parts = table.groupBy("block").cogroup(dense.groupBy("block")).applyInPandas(part, schema)
    return parts.groupBy(_block("word", blocks)).applyInPandas(whole, schema).select("word", "y", _block("word", blocks))


def _inner(left: str, right: str, rows: DataFrame, width: int) -> np.ndarray:
    """The sum over all rows of the outer products of two vectors."""
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((width, width))
        for b in batches:
            if len(b):
                sums += np.array(b[left].tolist()).T @ np.array(b[right].tolist())
        yield pd.DataFrame({"k": np.arange(width * width), "v": sums.ravel()})

    found = rows.select(*{left, right}).mapInPandas(f, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for r in found:
        out[r["k"]] = r["v"]
    return out.reshape(width, width)


def _times(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(y=list(np.array(b["y"].tolist()) @ matrix))

    return rows.mapInPandas(f, rows.schema)


def _orthonormal(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """A basis of the columns of (word, y, block), and how many it has."""
    size, turn = np.linalg.eigh(_inner("y", "y", rows, width))
    keep = size > max(size.max(), 0) * 1e-12
    return stored(_times(rows, turn[:, keep] / np.sqrt(size[keep]))), int(keep.sum())


def vectors(table: DataFrame, dims: int = DIMS, extra: int = EXTRA, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(word, vector) of a symmetric table (a, b, x), and the eigenvalues, the largest by size first."""
    spark = table.sparkSession
    words = table.select(F.col("a").alias("word")).distinct()
    n = words.count()
    if n > MOST:
        raise ValueError(f"{n} words; {MOST} at most")
    if not n:
        return spark.createDataFrame([], "word string, vector array<double>"), np.zeros(0)
    blocks, width = max(1, -(-n // BLOCK)), min(n, dims + extra)
    table = stored(table.select("a", "b", "x", _block("b", blocks)))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"word": b["word"], "y": list(_start(b["seed"].to_numpy(np.int64), width)), "block": b["block"]})

    dense = words.select("word", F.xxhash64("word", F.lit(7)).alias("seed"), _block("word", blocks)).mapInPandas(start, "word string, y array<double>, block long")
    for _ in range(rounds):
        dense, width = _orthonormal(stored(_product(table, dense, blocks)), width)
    seen = _product(table, dense, blocks).select("word", F.col("y").alias("z"))
    both = dense.join(seen, "word")
    small = _inner("y", "z", both, width)
    size, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-np.abs(size), kind="stable")[:dims]
    out = _times(dense, turn[:, top] * np.sqrt(np.abs(size[top])))
    return stored(out.select("word", F.col("y").alias("vector"))), size[top]


# --- likeness ------------------------------------------------------------------------------------


class Likeness:
    """Likeness of two texts by the mean vectors of their tokens. found: (word, vector); cost: of the segmenter."""

    def __init__(self, found: DataFrame, cost: Mapping[str, int], ignored: str = ""):
        rows = found.limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"more than {MOST} words")
        self.cost, self.ignored = dict(cost), ignored
        spark = found.sparkSession
        self.words = sent(spark, sorted(set(cost) - {""}))
        self.known = spark.sparkContext.broadcast({r["word"]: np.array(r["vector"], np.float32) for r in rows})

    def with_vectors(self, rows: DataFrame, text: str, name: str = "vector") -> DataFrame:
        """rows plus the mean vector of a column's tokens; null where none is known."""
        words, known, cost = self.words, self.known, self.cost

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, of = Lattice(words(), cost), known.value
            for b in batches:
                out = []
                for t in b.column(text).to_pylist():
                    found = [of[w] for w in lattice.cut(t or "") if w in of]
                    out.append(np.mean(np.array(found, np.float64), axis=0).tolist() if found else None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, name])

        return rows.mapInArrow(f, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))

    def __call__(self, pairs: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
        """pairs plus the likeness of two columns; each different text is looked at once."""
        clean = lambda c: F.regexp_replace(c, self.ignored, "") if self.ignored else F.col(c)
        texts = pairs.select(F.explode(F.array(a, b)).alias("text_")).distinct().withColumn("plain_", clean("text_"))
        known = stored(self.with_vectors(texts, "plain_").drop("plain_"))
        of = lambda c, v: known.select(F.col("text_").alias(f"{c}_t"), F.col("vector").alias(v))
        x, y = of("a", "va_"), of("b", "vb_")
        out = pairs.join(x, pairs[a].eqNullSafe(x["a_t"])).join(y, pairs[b].eqNullSafe(y["b_t"])).drop("a_t", "b_t")
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        cosine = dot("va_", "vb_") / F.sqrt(dot("va_", "va_") * dot("vb_", "vb_"))
        sides = lambda c: F.regexp_extract_all(F.col(c), F.lit("[左右]"), F.lit(0))
        value = F.when(F.isnan(cosine), 0.0).otherwise(F.coalesce(cosine, F.lit(0.0)))
        value = F.when((value > SIDES_FROM) & (sides(a) != sides(b)), value - SIDES_COST).otherwise(value)
        return out.withColumn(name, F.round(value, 6)).drop("va_", "vb_")
