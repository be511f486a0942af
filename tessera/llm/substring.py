"""Substring dedup: repeated windows of words, by Rabin-Karp hashes of every window.

A word is removed where a window of ``width`` consecutive words covers it whose words,
in order, also start somewhere in a document with a smaller id. All windows are judged
on the input. Overlapping windows merge into maximal removal intervals.

Plan, in three passes over documents that are gathered in blocks (``common``):

1. Count. A block sends the distinct hashes of all its windows to buckets by their leading
   bits; a bucket sorts them and returns, to every block, those that a second block has
   too. A passage in every document costs one hash per block. Hashes are cut to as many bits
   as there are windows, and ``SPARE`` more, and travel as differences: three bytes each.
2. Resolve. Windows that repeat (between blocks, or between documents of the block) are
   sent with both whole hashes, the second one of other word hashes and another base.
   Buckets find the smallest document of each 128-bit pair and return it to the blocks.
3. Remove. Blocks mark the covered words.

The cut hash only decides which windows are looked at again, so windows are equal
where two polynomials modulo 2**61 - 1, of two families of word hashes and two bases, agree.

Defined results: a null or empty text has no words; fewer than ``width`` words have no
window; repeated rows of one id don't remove each other's words, since no id is smaller;
a row without id comes after all ids, and rows without id don't remove from each other;
ties can't occur otherwise; ids are whole numbers, other types raise; an empty table
gives an empty result. Only id and text are read, so further columns, whatever their
names, don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BLOCK_BYTES, Scratch, block_of, block_partitions, by_part, distinct, pack, spread, squeezed, unpack, unsqueezed, window_sums, word_hashes, words

WIDTH = 50
#: Windows that one bucket sorts, on average.
BUCKET_WINDOWS = 4 << 20

#: Bits of a cut hash beyond those that number the windows: one window in 2 ** SPARE is looked at in vain.
SPARE = 8
#: Bytes of text whose windows are hashed at once; a longer text comes alone.
PIECE = 1 << 22


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of texts of about PIECE bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t or b"") > PIECE:
            yield first, held
            first, held, size = i, [], 0
        held.append(t or b"")
        size += len(t or b"")
    if held:
        yield first, held


class Words:
    """The words of a group of texts as hashes of one family, one text after the other."""

    def __init__(self, texts: list[bytes], which: int = 0):
        found = list(word_hashes(texts, which=which))
        self.which = which
        self.row = np.concatenate([r for r, _ in found] or [np.zeros(0, np.int64)])
        self.hash = np.concatenate([h for _, h in found] or [np.zeros(0, np.uint64)])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where a window of ``width`` words of one text starts, and the windows' hashes: equal for equal sequences of words."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: n - width + 1] == self.row[width - 1 :])
        return at, _mixed(window_sums(self.hash, at, width, self.which))


def cut_bits(windows: int) -> int:
    return min(64, max(16, max(1, windows).bit_length() + SPARE))


def _cut(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).view(np.int64) if bits < 64 else (h >> np.uint64(1)).view(np.int64)


def _count(width: int, buckets: int, bits: int):
    def f(docs: pa.Table) -> pa.Table:
        found = [_cut(Words(texts).windows(width)[1], bits) for _, texts in groups(unsqueezed(docs["text"]))]
        keys = distinct(*found)
        block = docs["block"][0].as_py()
        return _packed([(p, block, _squeeze(k)) for p, k in by_part(keys, _bucket(keys, buckets, bits))], _COUNTED)

    return f


def _bucket(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Equal ranges of the cut hashes."""
    width = -(-(1 << min(bits, 63)) // buckets)
    return keys // width


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack(np.diff(keys, prepend=0))


def _expand(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


_COUNTED = {"bucket": pa.int64(), "block": pa.int64(), "keys": pa.binary()}
#: ``known``: whether a row with an id has the window; ``firsts``: the smallest such id.
_RESOLVED = _COUNTED | {"seconds": pa.binary(), "known": pa.binary(), "firsts": pa.binary()}


def _packed(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, k) for c, k in zip(cols, schema.values(), strict=True)], list(schema))


def _ids(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an id, and the ids (zero where there is none)."""
    column = docs["doc_id"].combine_chunks()
    return column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block its hashes that another block has too."""
    each = [_expand(k) for k in pdf["keys"]]
    every = np.concatenate(each)
    every.sort()
    again = distinct(every[1:][every[1:] == every[:-1]])
    rows = []
    for block, keys in zip(pdf["block"], each, strict=True):
        if len(again) and len(k := keys[_member(keys, again)]):
            rows.append((block, _squeeze(k)))
    return pd.DataFrame(rows, columns=["block", "keys"])


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def _resolve(width: int, buckets: int, bits: int):
    def f(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _packed([], _RESOLVED)
        among = [_expand(k) for k in told["keys"].to_pylist()]
        has, ids = _ids(docs)
        texts = unsqueezed(docs["text"])
        # cut hashes that two documents of this block have
        own, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, part in groups(texts):
            w = Words(part)
            at, h = w.windows(width)
            own.append(_cut(h, bits))
            rows.append(first + w.row[at])
        own, rows = np.concatenate(own), np.concatenate(rows)
        order = np.lexsort((rows, own))
        own, rows = own[order], rows[order]
        among = distinct(*among, own[1:][(own[1:] == own[:-1]) & (rows[1:] != rows[:-1])])
        del own, rows, order
        found = []
        for first, part in groups(texts) if len(among) else ():
            w = Words(part)
            at, h = w.windows(width)
            if (hit := _member(_cut(h, bits), among)).any():
                row = first + w.row[at[hit]]
                found.append((h[hit].view(np.int64), Words(part, 1).windows(width)[1][hit].view(np.int64), has[row].astype(np.uint8), ids[row]))
        if not found:
            return _packed([], _RESOLVED)
        k, s, n, d, _ = _smallest(*map(np.concatenate, zip(*found, strict=True)))
        block = docs["block"][0].as_py()
        return _packed([(p, block, *map(pack, xs)) for p, *xs in by_part(k, spread(k, buckets), s, n, d)], _RESOLVED)

    return f


def _smallest(k: np.ndarray, s: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (k, s), ascending, each with the smallest d that is known (n), and for each entry the place of its pair."""
    order = np.lexsort((d, 1 - n, s, k))
    new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (s[order][1:] != s[order][:-1])])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    keep = order[new]
    return k[keep], s[keep], n[keep], d[keep], place


def _first_docs(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block the smallest document of each of its windows; windows of rows without id only are left out."""
    kinds = {"keys": np.int64, "seconds": np.int64, "known": np.uint8, "firsts": np.int64}
    each = {c: [unpack(x, t) for x in pdf[c]] for c, t in kinds.items()}
    k, s, n, d = (np.concatenate(x) for x in each.values())
    _, _, known, low, place = _smallest(k, s, n, d)
    cuts = np.cumsum([0, *map(len, each["keys"])])
    rows = []
    for block, x, y in zip(pdf["block"], cuts, cuts[1:], strict=False):
        at = np.arange(x, y)[known[place[x:y]] > 0]
        if len(at):
            rows.append((block, pack(k[at]), pack(s[at]), pack(low[place[at]])))
    return pd.DataFrame(rows, columns=["block", "keys", "seconds", "firsts"])


def removed(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` (a mask) cover."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(width: int, docs: pa.Table, told: pa.Table):
    """For each row: its text, and which of its words go (None if none does)."""
    k, s, d = (np.concatenate([unpack(x) for x in told[c].to_pylist()] or [np.zeros(0, np.int64)]) for c in ("keys", "seconds", "firsts"))
    if len(k):
        k, s, _, d, _ = _smallest(k, s, np.ones(len(k), np.uint8), d)
    has, ids = _ids(docs)
    texts = unsqueezed(docs["text"])
    for first, part in groups(texts):
        w = Words(part)
        at, h = w.windows(width)
        h = h.view(np.int64)
        hits = np.flatnonzero(_member(h, k))
        gone = np.zeros(len(w.hash), bool)
        if len(hits):
            second = Words(part, 1).windows(width)[1].view(np.int64)[hits]
            row = first + w.row[at[hits]]
            p = np.searchsorted(k, h[hits])
            while (off := (s[p] != second) & (p + 1 < len(k)) & (k[np.minimum(p + 1, len(k) - 1)] == k[p])).any():
                p = p + off
            starts = np.zeros(len(gone), bool)
            starts[at[hits]] = (s[p] == second) & ((d[p] < ids[row]) | ~has[row])
            gone = removed(starts, len(gone), width)
        cuts = np.searchsorted(w.row, np.arange(len(part) + 1))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield texts[first + i], int(b - a), gone[a:b] if gone[a:b].any() else None


def _stay(text: bytes | None, gone: np.ndarray | None) -> bytes:
    w = words(text)
    return b" ".join(w if gone is None else [x for x, g in zip(w, gone.tolist(), strict=True) if not g])


def _digest(width: int):
    def f(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = [(n, 0 if gone is None else int(gone.sum()), hashlib.sha256(_stay(t, gone)).hexdigest()) for t, n, gone in _kept(width, docs, told)]
        out = _packed(rows, {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()})
        return out.add_column(0, "doc_id", docs["doc_id"])

    return f


def _told(docs: DataFrame, scratch: Scratch, width: int, blocks: int, windows: int) -> DataFrame:
    """docs (doc_id long, text, block). (block, keys, seconds, firsts): the smallest document of every repeated window."""
    buckets, bits = max(1, math.ceil(windows / BUCKET_WINDOWS)), cut_bits(windows)
    counted = docs.groupBy("block").applyInArrow(_count(width, buckets, bits), "bucket long, block long, keys binary").repartition(block_partitions(buckets), "bucket")
    repeated = scratch.table(counted.groupBy("bucket").applyInPandas(_repeated, "block long, keys binary"))
    schema = "block long, keys binary, seconds binary"
    resolved = docs.groupBy("block").cogroup(repeated.repartition(block_partitions(blocks), "block").groupBy("block")).applyInArrow(_resolve(width, buckets, bits), f"bucket long, {schema}, known binary, firsts binary")
    return scratch.table(resolved.repartition(block_partitions(buckets), "bucket").groupBy("bucket").applyInPandas(_first_docs, f"{schema}, firsts binary")).repartition(block_partitions(blocks), "block")


def _blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, *more: Column) -> tuple[DataFrame, DataFrame, int, int]:
    """(doc_id, text, block), the same with further columns, the number of blocks and of windows, about."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    ready = lambda *c: squeezed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), block_of(blocks, id_col, text_col).alias("block"), *c)).repartition(block_partitions(blocks), "block")
    return ready(), ready(*more), blocks, total // 6


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    base, _, blocks, windows = _blocked(docs, id_col, text_col, block_bytes)
    told = _told(base, Scratch(docs.sparkSession), width, blocks, windows)
    return base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_digest(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with its columns, the text of a row replaced where words go; kept words are then joined by one space.

    A text of which nothing goes stays as it is, white space included.
    """
    others = [c for c in docs.columns if c != text_col]
    whole = F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")
    base, rows, blocks, windows = _blocked(docs, id_col, text_col, block_bytes, whole)
    told = _told(base, Scratch(docs.sparkSession), width, blocks, windows)
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def f(d: pa.Table, t: pa.Table) -> pa.Table:
        new = [text if gone is None else _stay(text, gone) for text, _, gone in _kept(width, d, t)]
        return pa.table([d["row"], pa.array([None if x is None else x.decode("utf-8", "surrogatepass") for x in new], pa.string())], ["row", "text"])

    out = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(f, schema)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
