"""A character language model: interpolated, modified Kneser-Ney smoothing.

A sentence becomes its ideographs (or what else ``others`` leaves), a start mark before and an end mark behind. The highest
order counts how often a gram occurs; a lower one counts how many different characters stand
before it, unless the gram starts the sentence. Of counts of 1, 2 and of 3 or more of an order
a discount each is taken, which follows from how many grams occur 1 to 4 times. What discounts
(and grams too rare to be kept) leave free in a context is its weight for the next shorter
context; below single characters stands the uniform distribution over characters, the end mark and
an unknown character. Probabilities of every context sum to one.

Everything is an aggregation by gram or context, or a join on one of them; each shorter gram of
a kept one is kept. Only counts of counts and the totals of single characters go to the driver:
they are values and no join, as they would be one key for all rows.

The model is a table (gram, n, p, backoff) of natural probabilities. ``backoff`` is the weight of
the gram as a context. The empty gram holds p of the unknown character. Grams are strings in
which each character is a token.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.corpus import PART
from tessera.scratch import stored

#: Longest grams, and for each order the greatest count that isn't kept.
ORDER, PRUNE = 4, (0, 0, 1, 1)
#: Discounts where the counts of counts allow none.
FALLBACK = (0.5, 1.0, 1.5)
START, END = "\x02", "\x03"
#: Characters that a task counts at once.
CHARS = 2_000_000


#: What is no token.
OTHERS = "[^\\u4e00-\\u9fff]"


def tokens(text: Column, others: str = OTHERS) -> Column:
    return F.regexp_replace(text, others, "")


def discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """Of counts of 1, 2 and 3 or more, from the numbers of grams that occur 1, 2, 3 and 4 times."""
    if not all((t1, t2, t3, t4)):
        return FALLBACK
    y = t1 / (t1 + 2 * t2)
    d = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else FALLBACK


def _counted(pieces: list[tuple[str, int]], order: int, often: list[int] | None = None) -> tuple[list[str], np.ndarray]:
    """The different runs of ``order`` characters, shorter ones at the ends of pieces, and how often each starts in a piece's own part; often: how many times each piece counts."""
    gap = order - 1
    size = np.array([len(x) for x, _ in pieces])
    ends = np.cumsum(size + gap)
    codes = np.frombuffer(("\0" * gap).join([*(x for x, _ in pieces), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    for k in range(1, gap + 1):
        codes[ends - k] = 0
    seen = np.zeros(0x110002, bool)
    seen[codes] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    base = len(letters)
    place = (np.cumsum(seen) - 1)[codes]
    starts = np.repeat(ends - size - gap - np.cumsum([0, *(own for _, own in pieces[:-1])]), [own for _, own in pieces])
    starts += np.arange(len(starts))
    place = np.append(place, np.zeros(gap, np.int64))
    grid = lambda: np.stack([place[starts + k] for k in range(order)], axis=1)
    if base**order < 2**62:
        key = np.zeros(len(starts), np.int64)
        for k in range(order):
            key = key * base + place[starts + k]
        key, which, times = np.unique(key, return_inverse=True, return_counts=True)
        runs = np.stack([key // base ** (order - 1 - k) % base for k in range(order)], axis=1)
    else:
        runs, which, times = np.unique(grid(), axis=0, return_inverse=True, return_counts=True)
    if often is not None:
        times = np.zeros(len(times), np.int64)
        np.add.at(times, which.ravel(), np.repeat(np.array(often, np.int64), [own for _, own in pieces]))
    chars = [chr(c - 1) if c else "" for c in letters.tolist()]
    return ["".join([chars[c] for c in run]) for run in runs.tolist()], times


def _windows(order: int):
    """Counts (w, times) of the runs of ``order`` characters, ``CHARS`` of text at a time; all shorter grams are their heads."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, often, size = [], [], 0

        def out():
            runs, times = _counted(held, order, often)
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(times, pa.int64())], names=["w", "times"])

        for b in batches:
            for t, n in zip(b.column("t").to_pylist(), b.column("times").to_pylist(), strict=True):
                for at in range(0, len(t), CHARS):
                    piece = t[at : at + CHARS + order - 1]
                    held.append((piece, min(CHARS, len(t) - at)))
                    often.append(n)
                    size += len(piece)
                    if size >= CHARS:
                        yield out()
                        held, often, size = [], [], 0
        if held:
            yield out()

    return f


def train(sentences: DataFrame, order: int = ORDER, prune: Sequence[int] = PRUNE, text: str = "sentence", others: str = OTHERS) -> DataFrame:
    """The model (gram, n, p, backoff) of the sentences, each as often as a column ``times`` says, if there is one; prune holds a limit for each order, none lower than the one before."""
    if order < 2 or len(prune) < order or prune[0] or any(a > b for a, b in zip(prune, prune[1:order], strict=False)):
        raise ValueError("an order of two or more, with rising limits from 0")
    spark = sentences.sparkSession
    times = F.col("times") if "times" in sentences.columns else F.lit(1).cast("long").alias("times")
    each = sentences.select(tokens(F.col(text), others).alias("t"), times).where("t <> ''").select(F.concat(F.lit(START), "t", F.lit(END)).alias("t"), "times")
    longest = stored(each.mapInArrow(_windows(order), "w string, times long").groupBy("w").agg(F.sum("times").alias("times")))
    heads = F.transform(F.sequence(F.lit(1), F.length("w")), lambda n: F.substring("w", F.lit(1), n))
    raw = stored(longest.select(F.explode(heads).alias("gram"), "times").where(F.col("gram") != START).groupBy("gram").agg(F.sum("times").alias("c")).withColumn("n", F.length("gram")))
    before = raw.where("n > 1").groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("kinds"))
    counted = raw.join(before, "gram", "left").select("gram", "n", "c", F.when((F.col("n") == order) | F.startswith("gram", F.lit(START)), F.col("c")).otherwise(F.col("kinds")).alias("a"))
    counted = stored(counted)

    often = {(r["n"], r["a"]): r["count"] for r in counted.where("a <= 4").groupBy("n", "a").count().collect()}
    by_order = {n: discounts(*(often.get((n, k), 0) for k in (1, 2, 3, 4))) for n in range(1, order + 1)}
    per_order = lambda values: reduce(lambda col, n: F.when(F.col("n") == n, values[n]).otherwise(col), sorted(values, reverse=True), F.lit(None))
    off = per_order({n: F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2]) for n, d in by_order.items()})
    keep = F.col("c") > per_order({n: F.lit(prune[n - 1]) for n in by_order})
    free = F.when(keep, off).otherwise(F.col("a"))

    # single characters: one context, the empty one
    single = counted.where("n = 1").agg(F.sum("a").alias("all"), F.sum(free).alias("free"), F.count("*").alias("kinds")).first()
    total, kinds = float(single["all"] or 1), single["kinds"] + 1
    unknown = (single["free"] or 1) / total / kinds
    contexts = counted.where("n > 1").withColumn("free", free).groupBy(F.expr("substring(gram, 1, n - 1)").alias("head")).agg(F.sum("a").alias("all"), F.sum("free").alias("free"))
    contexts = stored(contexts)
    share = counted.where(keep).withColumn("rest", F.col("a") - off)

    level = share.where("n = 1").select("gram", (F.col("rest") / total + unknown).alias("p"))
    levels = [level]
    for n in range(2, order + 1):
        grams = share.where(F.col("n") == n).select("gram", "rest", F.expr("substring(gram, 1, n - 1)").alias("head"), F.expr("substring(gram, 2)").alias("tail"))
        lower = stored(level).withColumnRenamed("gram", "tail").withColumnRenamed("p", "lower")
        level = grams.join(contexts, "head").join(lower, "tail").select("gram", (F.col("rest") / F.col("all") + F.col("free") / F.col("all") * F.col("lower")).alias("p"))
        levels.append(level)
    none = spark.createDataFrame([("", unknown)], "gram string, p double").unionByName(spark.createDataFrame([(START, 0.0)], "gram string, p double"))
    every = reduce(DataFrame.unionByName, levels, none)
    weight = contexts.select(F.col("head").alias("gram"), (F.col("free") / F.col("all")).alias("backoff"))
    return every.join(weight, "gram", "left").select("gram", F.length("gram").alias("n"), "p", "backoff")


def scores(texts: DataFrame, model: DataFrame, order: int = ORDER, bos: bool = False, eos: bool = False, others: str = OTHERS) -> DataFrame:
    """(text, lm): log10 probabilities of distinct texts' tokens, after a start mark and with the end mark if asked for; 0 without tokens."""
    plain = tokens(F.col("text"), others)
    whole = F.concat(F.lit(START if bos else ""), plain, F.lit(END if eos else ""))
    # in parts, each behind the last characters of the one before; what a token adds follows from itself and those before it
    cut = texts.select(F.sha2("text", 256).alias("key"), F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"))
    parts = F.transform("parts", lambda x, j: F.struct(F.when(j > 0, F.right(F.get("parts", j - 1), F.lit(order - 1))).otherwise("").alias("b"), x.alias("x"), j.alias("j")))
    at = cut.select("key", F.explode(parts).alias("p")).select("key", F.concat("p.b", "p.x").alias("t"), "p.j", F.length("p.b").alias("skip"))
    first = F.col("skip") + 1 + F.when(F.col("j") == 0, int(bos)).otherwise(0)
    run = lambda i: F.substring("t", F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order)))
    runs = F.transform(F.sequence(first, F.length("t")), run)
    used = at.where(F.length("t") >= first).select("key", F.explode(runs).alias("w"))
    found = stored(_run_scores(used.select("w").distinct(), model, order))
    out = used.join(found, "w").groupBy("key").agg(F.sum("lm").alias("lm"))
    return texts.select("text", F.sha2("text", 256).alias("key")).join(out, "key", "left").select("text", F.round(F.coalesce("lm", F.lit(0.0)), 6).alias("lm"))


def _run_scores(runs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(w, lm): the log10 probability of the last character of each run after those before it."""
    each = runs.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    each = each.select("w", "k", F.expr("right(w, k)").alias("gram"), F.expr("substring(right(w, k), 1, k - 1)").alias("head"))
    known = each.join(model.where("n > 0").select("gram", "p"), "gram", "left")
    # the empty context is never backed off from, so it needn't be looked up: it would be one key for all rows
    weights = model.where("backoff IS NOT NULL").select(F.col("gram").alias("head"), "backoff")
    longer = known.where("k > 1").join(weights, "head", "left").select("w", "k", "p", "backoff")
    every = known.where("k = 1").select("w", "k", "p", F.lit(None).cast("double").alias("backoff")).unionByName(longer)
    unknown = model.where("n = 0").select(F.col("p").alias("unknown"))
    per = every.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("k", "p", "backoff"))).alias("s"))
    best = F.array_max(F.transform(F.filter("s", lambda x: x["p"].isNotNull()), lambda x: x["k"]))
    per = per.withColumn("best", F.coalesce(best, F.lit(0))).crossJoin(F.broadcast(unknown))
    base = F.when(F.col("best") > 0, F.element_at("s", F.col("best"))["p"]).otherwise(F.col("unknown"))
    off = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.when((x["k"] > F.col("best")) & x["backoff"].isNotNull(), F.log10(x["backoff"])).otherwise(0.0))
    return per.select("w", (F.log10(base) + off).alias("lm"))
