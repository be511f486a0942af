"""Mixing sources to target weights by min-cost flow, then seeded selection.

Documents are aggregated by membership pattern, the set of sources they belong to. The
flow network runs from a start to each pattern (one arc for each repetition of its
words, at convex costs 0, 1, 3, 6, ...), from a pattern to its sources, and from a
source to the end with its target as capacity. Shortest paths route as many words as the
targets ask for while repeating as little as possible; those of one cost go together, as
blocking flows. The words that flow
through a pattern are then drawn from its documents: all of them as often as goes in
whole, and once more those whose seeded hash lies below a cut.

Scale. Only sums by pattern reach the driver: at most ``MAX_PATTERNS`` rows, which is
checked. The cut is the hash below which the documents of a pattern sum to the wanted
words; it is found exactly, eight bits of the hash at a time, from sums over 256 slices
of each pattern, so no window and no sort ever holds a pattern's documents. Every
further step reads only the slices at the cuts.

Defined results: a null text has size 0 and is never needed; a document without any
source (null or empty membership) is in the pattern of the null source; ids may be
null; rows that agree in id and text are taken equally often; ties of the hash likewise;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, words

#: Membership patterns on the driver; so many are routed in some ten seconds.
MAX_PATTERNS = 100_000
#: Rows at the cuts that are read on the driver once no more are left.
LAST_ROWS = 64

Source = str | None


@F.pandas_udf(T.LongType())
def word_count(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(words(t))).astype("int64")


def shares(sizes: dict[Source, int], weights: dict[Source, float], total: float, most: float) -> dict[Source, float]:
    """Targets by weight that stop at ``most`` times a source's size; the excess is shared again by weight."""
    out: dict[Source, float] = {}
    left, rest = dict(weights), float(total)
    while left:
        unit = rest / sum(left.values()) if sum(left.values()) > 0 else 0.0
        over = [s for s in left if unit * left[s] > most * sizes[s]]
        if not over:
            out |= {s: unit * w for s, w in left.items()}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            del left[s]
    return out


def route(patterns: dict[tuple[Source, ...], int], targets: dict[Source, int], repeats: int) -> dict[tuple[Source, ...], dict[Source, int]]:
    """Words that each pattern gives to each of its sources: a flow of greatest value and least convex cost.

    Only arcs from the start cost anything, so the cheapest path costs what its first arc does: the arcs of each repetition
    are opened in turn, the cheapest first, and each time the flow is made as large as it can be, by blocking flows.
    """
    names = list(patterns)
    sources = {s: k for k, s in enumerate(dict.fromkeys([*targets, *(s for p in names for s in p)]))}
    first, end = len(names), len(names) + len(sources)  # nodes: patterns, then sources, then the end
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        return len(to) - 2

    middle = [[(s, arc(i, first + sources[s], repeats * patterns[p])) for s in dict.fromkeys(p)] for i, p in enumerate(names)]
    for s, want in targets.items():
        arc(first + sources[s], end, max(0, want))
    supply = [0] * len(names)
    for _ in range(repeats):
        for i, p in enumerate(names):
            supply[i] += patterns[p]
        while True:
            # places on shortest ways from patterns with words left to the end
            level = [-1] * (end + 1)
            front = [i for i in range(len(names)) if supply[i]]
            for i in front:
                level[i] = 0
            depth = 0
            while front and level[end] < 0:
                depth += 1
                after = []
                for x in front:
                    for e in graph[x]:
                        if room[e] and level[to[e]] < 0:
                            level[to[e]] = depth
                            after.append(to[e])
                front = after
            if level[end] < 0:
                break
            at = [0] * (end + 1)  # arcs before these lead nowhere in this round
            for i in range(len(names)):
                path: list[int] = []
                x = i
                while supply[i] and level[i] == 0:
                    if x == end:
                        push = min(supply[i], min(room[e] for e in path))
                        for e in path:
                            room[e] -= push
                            room[e ^ 1] += push
                        supply[i] -= push
                        cut = next((k for k, e in enumerate(path) if not room[e]), 0)
                        x, path = to[path[cut] ^ 1], path[:cut]
                        continue
                    while at[x] < len(graph[x]):
                        e = graph[x][at[x]]
                        if room[e] and level[to[e]] == level[x] + 1:
                            break
                        at[x] += 1
                    if at[x] < len(graph[x]):
                        path.append(graph[x][at[x]])
                        x = to[path[-1]]
                    elif path:
                        x = to[path.pop() ^ 1]
                        at[x] += 1
                    else:
                        break
    return {p: {s: room[e ^ 1] for s, e in middle[i]} for i, p in enumerate(names)}


def _pattern_key(members: Column) -> Column:
    return F.to_json(members)


def sized(docs: DataFrame, members: Column, seed: int, id_col: str, text_col: str, keep: Iterable[Column] = ()) -> DataFrame:
    """(doc_id, members, pattern, size, key, *keep)."""
    m = F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string")))))
    m = F.when(F.size(m) == 0, F.array(F.lit(None).cast("string"))).otherwise(m)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), m.alias("members"), word_count(F.col(text_col)).alias("size"), seeded_key(F.col(id_col), text, seed).alias("key"), *keep)
    return base.withColumn("pattern", F.coalesce(_pattern_key(F.col("members")), F.lit("")))


def seeded_key(doc_id: Column, text: Column, seed: int) -> Column:
    """63 bits from seed, id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("string"), F.crc32(text)), 1)


def _cuts(rows: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """For each pattern the key below which its sizes sum to the wanted words as nearly as they can."""
    spark = rows.sparkSession
    cuts = {p: 0 for p, n in wanted.items() if n <= 0}
    left = {p: n for p, n in wanted.items() if n > 0}
    low = dict.fromkeys(left, 0)
    for shift in range(55, -1, -8):
        if not left:
            break
        at = F.broadcast(spark.createDataFrame([(p, low[p] >> (shift + 8)) for p in left], "pattern string, head long"))
        inside = rows.join(at, "pattern").where(F.shiftright("key", shift + 8) == F.col("head"))
        found = inside.groupBy("pattern", F.shiftright("key", shift).alias("slice")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        slices: dict[str, list[tuple[int, int, int]]] = {}
        for p, s, size, n in found.collect():  # 256 rows for each pattern at most
            slices.setdefault(p, []).append((s, size, n))
        for p in list(left):
            for s, size, n in sorted(slices.get(p, [])):
                if size > left[p]:
                    low[p] = s << shift
                    if n == 1 or shift == 0:  # its rows go together: nearer with or without them
                        cuts[p] = low[p] + (1 << shift if 2 * left[p] > size else 0)
                        del left[p]
                    break
                left[p] -= size
            else:
                cuts[p] = ((max((s for s, _, _ in slices.get(p, [])), default=low[p] >> shift)) + 1) << shift
                del left[p]
    return cuts


def decide(rows: DataFrame, targets: dict[Source, float] | None, repeats: int, weigh=None) -> tuple[DataFrame, dict[Source, int], dict[Source, float]]:
    """(decisions (pattern, copies, cut), source sizes, targets). rows: of ``sized``.

    targets may be None; ``weigh(source sizes)`` then gives them.
    """
    spark = rows.sparkSession
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["members"]): (r["pattern"], int(r["size"])) for r in found}
    sizes: dict[Source, int] = {}
    for p, (_, n) in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = weigh(sizes) if targets is None else targets
    flow = route({p: n for p, (_, n) in patterns.items()}, {s: round(t) for s, t in targets.items()}, repeats)
    copies, wanted = {}, {}
    for p, (key, n) in patterns.items():
        out = sum(flow[p].values())
        copies[key] = out // n if n else 0
        wanted[key] = out - copies[key] * n
    cuts = _cuts(rows, wanted)
    table = [(k, int(copies[k]), int(cuts[k])) for k in copies]
    return spark.createDataFrame(table, "pattern string, copies long, cut long"), sizes, targets


#: Weights of the sources in order of code points, again and again.
WEIGHTS = (5, 2, 1)


def cycled_targets(budget: float, repeats: int, weights: tuple[int, ...] = WEIGHTS):
    """Targets for sources in order of code points, null last, that share ``budget`` times all sizes."""

    def f(sizes: dict[Source, int]) -> dict[Source, float]:
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        return shares(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, budget * sum(sizes.values()), repeats)

    return f


def mix_sizes(docs: DataFrame, budget: float = 1.5, repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row; each document has one source."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(sized(docs, F.array(F.col(source_col).cast("string")), seed, id_col, text_col))
    table, sizes, targets = decide(rows, None, repeats, cycled_targets(budget, repeats))
    told = docs.sparkSession.createDataFrame([(s, int(n), float(targets[s])) for s, n in sizes.items()], "source string, source_size long, target double")
    out = rows.join(F.broadcast(table), "pattern").withColumn("source", F.col("members")[0])
    out = out.join(F.broadcast(told.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
    times = F.col("copies") + (F.col("key") < F.col("cut")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("copies"))


def mix_documents(docs: DataFrame, budget: float = 1.5, repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[Source, float] | None = None, members: Column | None = None) -> DataFrame:
    """docs with its columns: each row as often as the mix takes it.

    members: an array of sources, for documents that belong to several; targets: words by source.
    """
    spark = docs.sparkSession
    members = F.array(F.col(source_col).cast("string")) if members is None else members
    weigh = cycled_targets(budget, repeats)
    rows = Scratch(spark).table(sized(docs, members, seed, id_col, text_col))
    table, _, _ = decide(rows, targets, repeats, weigh)
    m = F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string")))))
    m = F.when(F.size(m) == 0, F.array(F.lit(None).cast("string"))).otherwise(m)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(_pattern_key(m), F.lit("")).alias("pattern"), seeded_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), seed).alias("key"))
    times = F.col("copies") + (F.col("key") < F.col("cut")).cast("long")
    out = row.join(F.broadcast(table), "pattern").select("row", times.alias("times")).where("times > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
