"""The body axis: intervals that meet, and names that stand for several nodes.

Intervals meet by a range join: each goes to the bins of the axis that it touches, rows meet on
equality of keys and bin, and a pair counts in the first bin that both touch, so none comes twice
and no nested loop compares all with all. The rest is residual: the ranges overlap and start at
most ``GAP`` apart. In the folded form coordinates of the limbs (``FOLD`` and beyond) lose their
hundreds, which lets an arm meet what lies beside it.

An entity whose name has several paths keeps, step by step, those candidates that a step speaks
for, if these are some but not all: wording of the spine, the exam's range, the unambiguous entity
of the report with which a candidate shares most nodes, the ranges of these entities, the same
folded, and the deepest path. Every step is a join or a window by report and entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 50.0
#: The largest difference of starts, and the coordinate from which on hundreds don't count.
GAP, FOLD = 100.0, 500.0
#: Wording of the spine, and the root that it never means.
SPINE, NOT_SPINE = "椎|横突|棘|脊|肋|骶", "盆腔"


def folded(x: Column) -> Column:
    return F.when(x < FOLD, x).otherwise(x % 100)


def _binned(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    first, last = F.floor(F.least(lo, hi) / BIN), F.floor(F.greatest(lo, hi) / BIN)
    return rows.select("*", first.alias("first_"), F.explode(F.sequence(first, last)).alias("bin_"))


def meeting(a: DataFrame, b: DataFrame, keys: Sequence[str], fold: bool = False, gap: float = GAP) -> DataFrame:
    """Pairs of rows of a (…, lo, hi) and b (…, lo, hi), each pair once; b's columns get the prefix b_. Null ranges meet nothing."""
    put = (lambda c: folded(F.col(c))) if fold else F.col
    known = lambda df: df.where("lo IS NOT NULL AND hi IS NOT NULL").select("*", put("lo").alias("x_"), put("hi").alias("y_"))
    left = _binned(known(a), "x_", "y_")
    right = _binned(known(b), "x_", "y_")
    right = right.select(*(F.col(c).alias(c if c in keys or c == "bin_" else f"b_{c}") for c in right.columns))
    on = (F.col("x_") < F.col("b_y_")) & (F.col("b_x_") < F.col("y_")) & (F.abs(F.col("x_") - F.col("b_x_")) <= gap)
    met = left.join(right, [*keys, "bin_"]).where(on & (F.col("bin_") == F.greatest("first_", "b_first_")))
    return met.select(*keys, *(c for c in a.columns if c not in keys), *(f"b_{c}" for c in b.columns if c not in keys))


def _kept(cands: DataFrame, by: Sequence[str], for_it: Column) -> DataFrame:
    """cands without those that a step doesn't speak for, where it speaks for some of an entity's."""
    w = Window.partitionBy(*by)
    out = cands.withColumn("for_", F.coalesce(for_it, F.lit(False)))
    out = out.withColumn("some_", F.bool_or("for_").over(w))
    return out.where("for_ OR NOT some_").drop("for_", "some_")


def disambiguated(ents: DataFrame, exams: DataFrame, report: str = "report_id", at: Sequence[str] = ("field", "sentence_index", "start", "match_no")) -> DataFrame:
    """ents (a row for each path of each entity: report, ``at``, sentence, path, lo, hi) without the paths that give way, plus n_before and n_after.

    exams: (report, lo, hi) of the exam's parts; an exam of several paths counts with the first.
    """
    by = [report, *at]
    every = Window.partitionBy(*by)
    rows = ents.withColumn("n_before", F.count("*").over(every).cast("int"))
    one = rows.where("n_before = 1").select(report, F.struct(*at).alias("at_"), F.col("path").alias("path_"), "lo", "hi")
    cands = rows.where("n_before > 1")
    nodes = lambda c: F.split(c, ">")
    ids = [*by, "path"]
    hit = lambda other, fold=False: meeting(cands.select(*ids, "lo", "hi"), other.select(report, "lo", "hi"), [report], fold).select(*ids).distinct().withColumn("hit_", F.lit(True))

    cands = _kept(cands, by, ~(F.col("sentence").rlike(SPINE) & (nodes("path")[0] == NOT_SPINE)))
    cands = _kept(cands.join(hit(exams), ids, "left"), by, F.col("hit_").isNotNull()).drop("hit_")
    shared = F.size(F.array_intersect(nodes("path"), nodes("path_")))
    common = cands.select(*ids).join(one.select(report, "at_", "path_"), report).select(*ids, "at_", shared.alias("n_")).where("n_ > 0")
    # most nodes in common; then the first entity, then the first path
    best = common.groupBy(*by).agg(F.min_by("path", F.struct(-F.col("n_"), "at_", "path")).alias("best_"))
    cands = _kept(cands.join(best, by, "left"), by, F.col("path") == F.col("best_")).drop("best_")
    for fold in (False, True):
        cands = _kept(cands.join(hit(one, fold), ids, "left"), by, F.col("hit_").isNotNull()).drop("hit_")
    deep = F.size(nodes("path"))
    cands = _kept(cands.withColumn("deep_", deep), by, F.col("deep_") == F.max("deep_").over(every)).drop("deep_")
    out = rows.where("n_before = 1").unionByName(cands)
    return out.withColumn("n_after", F.count("*").over(every).cast("int"))
