"""How alike words sound: edit distance over syllables, and words that sound alike in a lexicon.

A syllable has an initial and a final. Two that agree cost nothing, two whose initials and
finals agree or are easily confused cost one half, others one; so does a syllable too many. Pairs
are found by deletion neighbourhoods: easily confused sounds share a class, and words within a
distance of k have a sequence of classes in common after at most k deletions each. They meet on
equality, and only then the distance is computed.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Initials, the longest first; initials and finals that are easily confused.
INITIALS = ("zh", "ch", "sh", "z", "c", "s", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "r", "y", "w")
NEAR_INITIALS = (("z", "zh"), ("c", "ch"), ("s", "sh"), ("n", "l"), ("f", "h"), ("r", "l"))
NEAR_FINALS = (("en", "eng"), ("in", "ing"), ("an", "ang"), ("un", "ong"))
NEAR_COST = 0.5


def split(syllable: str) -> tuple[str, str]:
    """Initial and final."""
    first = next((i for i in INITIALS if syllable.startswith(i)), "")
    return first, syllable[len(first) :]


def near_finals(a: str, b: str) -> bool:
    """Whether one ends where the other does, but for an ending that is easily confused."""
    return any(a.endswith(x) and b.endswith(y) and a[: len(a) - len(x)] == b[: len(b) - len(y)] for p in NEAR_FINALS for x, y in (p, p[::-1]))


def cost(a: str, b: str) -> float:
    """Of one syllable for another."""
    if a == b:
        return 0.0
    (i, f), (j, g) = split(a), split(b)
    starts = i == j or (i, j) in NEAR_INITIALS or (j, i) in NEAR_INITIALS
    return NEAR_COST if starts and (f == g or near_finals(f, g)) else 1.0


def distance(a: list[str], b: list[str]) -> float:
    row = [float(k) for k in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + cost(x, y))
    return row[-1]


@F.pandas_udf(T.DoubleType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def sound_distance(a: Column, b: Column) -> Column:
    """Of two arrays of syllables."""
    return _distances(a, b)


def _class(syllable: Column) -> Column:
    """One name for all syllables that a chain of easily confused ones connects."""
    first = F.regexp_extract(syllable, f"^({'|'.join(INITIALS)})?", 1)
    rest = F.substring(syllable, F.length(first) + 1, F.length(syllable))
    first = reduce(lambda c, kv: F.when(first.isin(*kv[0]), kv[1]).otherwise(c), ((("z", "zh"), "z"), (("c", "ch"), "c"), (("s", "sh"), "s"), (("n", "l", "r"), "l"), (("f", "h"), "f")), first)
    rest = F.regexp_replace(F.regexp_replace(rest, "(e|i|a)ng$", "$1n"), "(un|ong)$", "un")
    return F.concat(first, F.lit("."), rest)


def sounded(words: DataFrame, table: DataFrame, word: str = "word") -> DataFrame:
    """words plus (syllables, classes). table: (char, syllable); of several readings the first by name. Words with a character that it lacks are left out."""
    one = table.groupBy(F.col("char").alias("ch")).agg(F.min("syllable").alias("syllable"))
    each = words.select(F.col(word).alias("w_")).where("w_ <> ''").distinct().select("w_", F.posexplode(F.split("w_", "")).alias("i", "ch"))
    by = F.array_sort(F.collect_list(F.struct("i", "syllable", _class(F.col("syllable")).alias("class"))))
    said = each.join(one, "ch").groupBy("w_").agg(by.alias("s")).where(F.size("s") == F.length("w_"))
    said = said.select("w_", F.transform("s", lambda x: x["syllable"]).alias("syllables"), F.transform("s", lambda x: x["class"]).alias("classes"))
    return words.join(said, words[word] == said["w_"]).drop("w_")


def _fewer(xs: Column) -> Column:
    """xs without each of its elements in turn."""
    n = F.size(xs)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice(xs, F.lit(1), i - 1), F.slice(xs, i + 1, n)))


def neighbourhood(classes: Column, most: int) -> Column:
    """All sequences after at most ``most`` deletions, as strings."""
    every = level = F.array(classes)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.size(x) > 0), _fewer)))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda x: F.array_join(x, " ")))


def alike(left: DataFrame, right: DataFrame, most: float = 1.0) -> DataFrame:
    """(word, other, distance): pairs of different words of two tables of ``sounded`` that sound at most so far apart."""
    keys = lambda df, name: df.select(F.col("word").alias(name), F.explode(neighbourhood(F.col("classes"), int(most))).alias("key"))
    pairs = keys(left, "word").join(keys(right, "other"), "key").where("word <> other").select("word", "other").distinct()
    said = lambda df, name, s: df.select(F.col("word").alias(name), F.col("syllables").alias(s)).distinct()
    pairs = pairs.join(said(left, "word", "a_"), "word").join(said(right, "other", "b_"), "other")
    return pairs.select("word", "other", sound_distance(F.col("a_"), F.col("b_")).alias("distance")).where(F.col("distance") <= most)


def sound_confusions(freq: DataFrame, table: DataFrame, least_right: int, most_wrong: int = 50, most: float = 1.0) -> DataFrame:
    """(wrong, correct, w_freq, c_freq, distance): rare words that sound like frequent ones. freq: (word, freq)."""
    said = sounded(freq.where(F.length("word").between(2, 8)), table)
    pairs = alike(said.where(F.col("freq") <= most_wrong), said.where(F.col("freq") >= least_right), most)
    f = lambda name, n: freq.select(F.col("word").alias(name), F.col("freq").alias(n))
    return pairs.select(F.col("word").alias("wrong"), F.col("other").alias("correct"), "distance").join(f("wrong", "w_freq"), "wrong").join(f("correct", "c_freq"), "correct").select("wrong", "correct", "w_freq", "c_freq", "distance")
