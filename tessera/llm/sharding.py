"""Sharding by a Feistel permutation of global row numbers; law ``rows``.

Rows are numbered 0..n-1 in a fixed order, the numbers are permuted by a keyed Feistel
network over the next even power of two, values beyond n walk on along their cycle, and
``position % shards`` and ``position // shards`` are shard and slot. So shard sizes
differ by one at most, slots are gapless, and both directions can be computed from the
seed alone: ``place`` gives shard and slot of a row number, ``row_number`` the reverse.

The order of rows: by a hash of (id, size, CRC) that deals them to buckets, then by
those three values within a bucket. Rows that agree in all three are alike in the
result, so they are counted before the shuffle and numbered together: a row that is
repeated any number of times is one entry. Bucket sizes, one row for some 100,000
documents, are summed on the driver.

Defined results: null text has size 8 (no bytes) and CRC 0; null ids are ordinary
values; copies and repeated rows get places of their own; an empty table gives an empty
result; fewer rows than shards leave the last shards empty. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

ROUNDS = 6
BUCKET_ROWS = 100_000
#: Repeats of one row that are written out by one task.
RUN = 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[np.uint64]:
    return [np.uint64(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))]


def _network(x: np.ndarray, half: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left + k) & mask), left
        else:
            left, right = right, left ^ (_mix(right + k) & mask)
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, or its inverse, of each number."""
    if not len(numbers):
        return np.zeros(0, np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = _round_keys(seed)
    out = _network(numbers.astype(np.uint64), half, keys, back)
    while (far := out >= n).any():  # cycle walking ends, as each number is on a cycle with its own start
        out[far] = _network(out[far], half, keys, back)
    return out.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    at = permute(numbers, n, seed)
    return at % shards, at // shards


def row_number(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    return permute(slot * shards + shard, n, seed, back=True)


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = scratch.table(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times")))
    n, most = rows.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    buckets = 1 << max(4, (n // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    sizes = dict(rows.groupBy("bucket").agg(F.sum("times")).collect())
    starts, total = [], 0
    for b in range(buckets):
        starts.append((b, total))
        total += sizes.get(b, 0)
    before = docs.sparkSession.createDataFrame(starts, "bucket long, start long")
    order = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(before), "bucket").withColumn("first", F.col("start") + F.coalesce(F.sum("times").over(order), F.lit(0)))
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    if most > RUN:
        runs = runs.hint("rebalance")
    last = F.least(F.col("times"), (F.col("run") + 1) * RUN) - 1
    numbered = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, last))).withColumn("number", F.col("first") + F.col("nth"))

    @F.pandas_udf("shard int, slot long")
    def places(number: pd.Series) -> pd.DataFrame:
        shard, slot = place(number.to_numpy(np.int64), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    out = numbered.withColumn("place", places("number"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "place.shard", "place.slot", F.lit(None).cast("int").alias("grown_shard"))
