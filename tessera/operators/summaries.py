"""Summaries of parts of a corpus that are kept and merged: exact sums, and sketches of distinct words and of lengths.

A part (a day, a source) is read once; its summary is a row of some kilobytes. Figures of any
set of parts come from their rows alone: numbers of texts, words and letters exactly, distinct
words by HyperLogLog, quantiles of lengths by KLL. Both sketches are merged without loss: the
merged one errs no more than one of all rows.

Bounds. Distinct words: the standard error is 1.04 / sqrt(2 ** LG_K); figures stay within three of
them. Quantiles: the rank of what is returned differs from what was asked by RANK_ERROR at most,
with a probability of 99 %.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: 2 ** LG_K registers, K items a level.
LG_K, K = 12, 400
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(2**LG_K)
#: 99 % bound of the rank of a single quantile, for K items.
RANK_ERROR = 2.296 / K**0.9021
WORD = "[A-Za-zÀ-ÿ一-鿿]+"
PARTS = ("n_texts", "n_words", "n_letters")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def summarised(rows: DataFrame, part: Sequence[str], text: str = "text") -> DataFrame:
    """A row for each part: its columns, n_texts, n_words, n_letters, and the sketches ``distinct`` and ``lengths``. Null texts are empty."""
    t = F.coalesce(text, F.lit(""))
    each = rows.select(*part, F.length(t).cast("long").alias("size"), words(t).alias("ws"))
    sums = each.groupBy(*part).agg(F.count("*").alias("n_texts"), F.sum(F.size("ws")).alias("n_words"), F.sum("size").alias("n_letters"), F.kll_sketch_agg_bigint("size", F.lit(K)).alias("lengths"))
    seen = each.select(*part, F.explode("ws").alias("w")).groupBy(*part).agg(F.hll_sketch_agg("w", LG_K).alias("distinct"))
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in part]
    on = keys[0] if len(keys) == 1 else F.lit(True)
    for k in keys if len(keys) > 1 else ():
        on = on & k
    return sums.alias("s").join(seen.alias("d"), on, "left").select("s.*", "d.distinct")


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``summarised`` put together by some of their columns, or all as one."""
    sums = [F.sum(c).alias(c) for c in PARTS]
    return parts.groupBy(*by).agg(*sums, F.kll_merge_agg_bigint("lengths", F.lit(K)).alias("lengths"), F.hll_union_agg("distinct").alias("distinct"))


def figures(parts: DataFrame, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """parts with their sketches read: unique_words, and length_50 and so on."""
    at = [F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(q))).alias(f"length_{round(100 * q)}") for q in quantiles]
    keep = [c for c in parts.columns if c not in ("lengths", "distinct")]
    return parts.select(*keep, F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("unique_words"), *at)
