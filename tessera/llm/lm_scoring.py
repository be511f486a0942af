"""LM scoring: context-tree weighting over bytes, beside a unigram base score.

``score_documents`` learns from the rows that ``train`` marks and scores all rows.

* The model is that of ``context_tree``: every byte is eight binary decisions, every
  decision has a tree of byte contexts of depth ``depth`` (beyond ``across`` bytes within
  the word only), and Krichevsky-Trofimov estimates of all depths are mixed. The scored stream is the lower-cased words joined
  by one space and closed by an end mark, so its events are those of the base score.
* The base score is that of single tokens, smoothed by one.

Plan. Documents are gathered in blocks (``common``). A block sends its distinct grams
and words, packed, to buckets by hash; buckets sum the training counts. The distinct
grams, whose number saturates, are dealt again by the two bytes nearest to the
predicted one, where subtrees are weighted from the leaves up; the two topmost levels
(at most 65 535 nodes, a fixed bound) are finished on the driver and sent back. The
resulting log probability of each gram and the count of each word return to the blocks
that asked for them, in the order of the sorted grams and hashes, which the block derives
once more instead of getting them back. Log probabilities travel as whole multiples of
2 ** -``FIXED``, so that a byte's is exact to 1.2e-10. Words are told apart by 64-bit hashes.
No table is broadcast, none grows in
one task with the corpus: a gram or word that occurs everywhere costs one entry per block.

Defined results: a null text counts as empty (only the end is scored); a null id is a
training row; repeated ids are scored row by row; an empty table gives an empty
result; with no training row all probabilities are those of no counts (one half per
bit) and base_score uses N = V = 0. Only id, text and the mark are read from the
input, so further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import context_tree as ct
from tessera.llm.common import (
    Scratch,
    block_count,
    block_of,
    block_partitions,
    by_part,
    distinct,
    lower_words,
    pack,
    spread,
    squeezed,
    unpack,
    unsqueezed,
    word_hashes,
)

DEPTH, ACROSS = ct.DEPTH, ct.ACROSS
#: Bytes of text in a block: larger ones hold fewer distinct grams a byte.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are turned into grams or words at once, and grams that are sorted at once.
PIECE, SORTED = 1 << 20, 1 << 23
#: What stands for the end among the words' hashes.
_END = 0
#: Log probabilities travel as whole multiples of 2 ** -FIXED.
FIXED = 32

_PACKED = "kind string, bucket long, block long, keys binary, vals binary"


def _pieces(streams: list[bytes], depth: int, across: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, gram codes, start of each row's codes), a bounded number of codes at a time."""
    at: list[int] = []
    size = 0
    for i, s in enumerate(streams):
        if len(s) > PIECE:
            padded = b"\xff" * depth + s
            for off in range(0, len(s), PIECE):
                part = np.frombuffer(padded[off : off + PIECE + depth], np.uint8)
                yield np.array([i]), ct.grams_of(part, depth, across), np.zeros(1, np.int64)
            continue
        at.append(i)
        size += len(s)
        if size > PIECE:
            yield np.array(at), *ct.codes([streams[j] for j in at], depth, across)
            at, size = [], 0
    if at:
        yield np.array(at), *ct.codes([streams[j] for j in at], depth, across)


def _gram_counts(streams: list[bytes], depth: int, across: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often each occurs; at most ``SORTED`` are held at once."""
    room = np.empty(min(SORTED, sum(map(len, streams))), np.int64)
    found, used = [], 0
    for _, code, _ in _pieces(streams, depth, across):
        while len(code):
            take = min(len(code), len(room) - used)
            room[used : used + take] = code[:take]
            code, used = code[take:], used + take
            if used == len(room):
                found.append(ct.distinct(room))
                used = 0
    if used:
        found.append(ct.distinct(room[:used]))
    del room
    return found[0] if len(found) == 1 else ct.merge_counts([k for k, _ in found], [n for _, n in found])


def _grams(streams: list[bytes], depth: int, across: int) -> np.ndarray:
    """Distinct grams only, which takes a third of the memory."""
    found, size = [], 0
    for _, code, _ in _pieces(streams, depth, across):
        found.append(distinct(code))
        size += len(found[-1])
        if size > SORTED // 4:
            found = [distinct(*found)]
            size = 0
    return distinct(*found) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)


_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, ct.END]] = True


def _word_pieces(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word, a bounded number at a time."""
    return ((rows, h.view(np.int64)) for rows, h in word_hashes(streams, _BETWEEN))


def _word_counts(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [ct.distinct(h) for _, h in _word_pieces(streams)]
    found.append((np.array([_END]), np.array([len(streams)])))
    return ct.merge_counts([k for k, _ in found], [n for _, n in found])


def _gather(depth: int, across: int, buckets: int):
    """A block's distinct grams and words with their training counts, packed by bucket."""

    def f(docs: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py()
        streams: tuple[list[bytes], list[bytes]] = ([], [])
        for text, train in zip(unsqueezed(docs["text"]), docs["train"].to_pylist(), strict=True):
            streams[int(train)].append(ct.stream(lower_words(text)))
        rows = []
        for kind, counted in (("g", lambda x: _gram_counts(x, depth, across)), ("w", _word_counts)):
            unseen, _ = counted(streams[0])
            seen, n = counted(streams[1])
            keys, counts = ct.merge_counts([unseen, seen], [np.zeros(len(unseen), np.int64), n])
            rows += [(kind, part, block, pack(k), pack(c)) for part, k, c in by_part(keys, spread(keys, buckets), counts)]
        return _table(rows, ["kind", "bucket", "block", "keys", "vals"], _PACKED)

    return f


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], names: list[str], schema: str) -> pa.Table:
    kinds = [_KINDS[c.split()[1]] for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _sum_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a bucket's words, for each block that holds them; n_all and n_known once."""
    each = [unpack(k) for k in pdf["keys"]]
    keys, n = ct.merge_counts(each, [unpack(v) for v in pdf["vals"]])
    vals = [pack(n[np.searchsorted(keys, k)]) for k in each]
    out = pd.DataFrame({"kind": "w", "block": pdf["block"], "bucket": pdf["bucket"], "vals": vals, "n_all": 0, "n_known": 0})
    out.loc[out.index[0], ["n_all", "n_known"]] = [int(n.sum()), int((n > 0).sum())]
    return out


def _sum_grams(tree_parts: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        """Distinct grams of a bucket with their counts, packed by the bytes nearest to the predicted one."""
        grams, n = ct.merge_counts([unpack(k) for k in pdf["keys"]], [unpack(v) for v in pdf["vals"]])
        root = (grams >> 8) & ((1 << 8 * ct.TOP) - 1)
        rows = [(p, int(pdf["bucket"].iloc[0]), pack(k), pack(c)) for p, k, c in by_part(grams, spread(root, tree_parts), n)]
        return pd.DataFrame(rows, columns=["part", "bucket", "keys", "vals"])

    return f


def _subtrees(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, counts, bucket) of each subtree in a part."""
    each = [unpack(k) for k in pdf["keys"]]
    grams, counts = np.concatenate(each), np.concatenate([unpack(v) for v in pdf["vals"]])
    bucket = np.repeat(pdf["bucket"].to_numpy(), [len(k) for k in each])
    root = (grams >> 8) & ((1 << 8 * ct.TOP) - 1)
    order = np.lexsort((grams, root))
    grams, counts, bucket, root = grams[order], counts[order], bucket[order], root[order]
    # neighbouring small subtrees go together; a large one goes alone
    cuts, last = [0], 0
    for c in np.flatnonzero(root[1:] != root[:-1]) + 1:
        if c - last >= 50_000:
            cuts.append(int(c))
            last = c
    for a, b in zip(cuts, [*cuts[1:], len(grams)], strict=True):
        yield grams[a:b], counts[a:b], bucket[a:b]


def _roots(depth: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grams, counts, _ in _subtrees(pdf):
            o = np.argsort(grams)
            t = ct.Levels(grams[o], counts[o], depth)
            out.append(pd.DataFrame({"above": t.keys[ct.TOP] & 0xFFFF, "n0": t.n0[ct.TOP], "n1": t.n1[ct.TOP], "below": t.log_pw[ct.TOP]}))
        return pd.concat(out).groupby("above", as_index=False).sum()

    return f


def _probabilities(depth: int, reach: np.ndarray, rest: np.ndarray):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for grams, counts, bucket in _subtrees(pdf):
            o = np.argsort(grams)
            t = ct.Levels(grams[o], counts[o], depth)
            for p, k, v in by_part(grams, bucket, t.log10_bytes(grams, reach, rest)):
                o = np.argsort(k)
                rows.append((p, pack(k[o]), pack(np.rint(v[o] * -(2.0**FIXED)).astype(np.int64))))
        return pd.DataFrame(rows, columns=["bucket", "keys", "vals"])

    return f


def _answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For each block that asked this bucket: the log probabilities of its grams, in their order."""
    k = np.concatenate([unpack(x) for x in known["keys"]])
    v = np.concatenate([unpack(x) for x in known["vals"]])
    order = np.argsort(k)
    k, v = k[order], v[order]
    vals = [pack(v[np.searchsorted(k, unpack(x))]) for x in asked["keys"]]
    return pd.DataFrame({"kind": "g", "block": asked["block"], "bucket": asked["bucket"], "vals": vals})


def _score(depth: int, across: int, buckets: int, n_all: int, n_known: int):
    shift = math.log10(n_all + n_known + 1)

    def f(docs: pa.Table, told: pa.Table) -> pa.Table:
        streams = [ct.stream(lower_words(t)) for t in unsqueezed(docs["text"])]
        answers = {(k, p): v for k, p, v in zip(*(told[c].to_pylist() for c in ("kind", "bucket", "vals")), strict=True)}

        def answered(kind: str, keys: np.ndarray) -> np.ndarray:
            vals = np.zeros(len(keys), np.int64)
            for p, at in by_part(np.arange(len(keys)), spread(keys, buckets)):
                vals[at] = unpack(answers[kind, p])
            return vals

        rows_n = len(streams)
        words, _ = _word_counts(streams)
        count = answered("w", words) if rows_n else words
        n, known, base = (np.full(rows_n, x) for x in (1, 0, 0.0))
        if rows_n:  # the end of each text
            end = count[np.searchsorted(words, _END)]
            known += int(end > 0)
            base += math.log10(end + 1)
        for rows, h in _word_pieces(streams):
            order = np.argsort(h)
            c = np.empty(len(h), np.int64)
            c[order] = count[np.searchsorted(words, h[order])]
            n += np.bincount(rows, minlength=rows_n)
            known += np.bincount(rows[c > 0], minlength=rows_n)
            base += np.bincount(rows, weights=np.log10(c + 1), minlength=rows_n)
        base -= n * shift
        keys = _grams(streams, depth, across)
        vals = answered("g", keys)
        score = np.zeros(rows_n)
        for rows, code, starts in _pieces(streams, depth, across):
            order = np.argsort(code)
            each = np.empty(len(code))
            each[order] = vals[np.searchsorted(keys, code[order])]
            score[rows] -= np.add.reduceat(each, starts) / 2.0**FIXED
        n_bytes = np.array([len(s) for s in streams])
        cols = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([n_all] * rows_n, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(-score * math.log2(10) / n_bytes)]
        held = pa.array([not t for t in docs["train"].to_pylist()], pa.bool_())
        return pa.table([docs["doc_id"], held, *cols], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return f


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, across: int = ACROSS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    blocks = block_count(docs, block_bytes=block_bytes)
    buckets = math.ceil(blocks / 2)
    docs = squeezed(docs.withColumn("block", block_of(blocks, "doc_id", "text"))).repartition(block_partitions(blocks), "block")
    packed = scratch.table(docs.groupBy("block").applyInArrow(_gather(depth, across, buckets), _PACKED))
    grams = packed.where("kind = 'g'").select("bucket", "block", "keys", "vals").repartition(buckets, "bucket")
    words = packed.where("kind = 'w'").select("bucket", "block", "keys", "vals").repartition(buckets, "bucket")

    words = scratch.table(words.groupBy("bucket").applyInPandas(_sum_words, "kind string, block long, bucket long, vals binary, n_all long, n_known long"))
    n_all, n_known = words.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()

    tree = scratch.table(grams.groupBy("bucket").applyInPandas(_sum_grams(buckets), "part long, bucket long, keys binary, vals binary"))
    tree_by_part = tree.repartition(buckets, "part").groupBy("part")
    top = tree_by_part.applyInPandas(_roots(depth), "above long, n0 long, n1 long, below double").groupBy("above").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).toPandas()  # 65 280 rows at most
    above = top["above"].to_numpy(np.int64)
    reach, rest = ct.tops(above >> 8, above & 0xFF, *(top.iloc[:, k].to_numpy() for k in (1, 2, 3)))
    known = tree_by_part.applyInPandas(_probabilities(depth, reach, rest), "bucket long, keys binary, vals binary").repartition(buckets, "bucket")
    asked = grams.select("bucket", "block", "keys").groupBy("bucket")
    told = asked.cogroup(known.groupBy("bucket")).applyInPandas(_answer, "kind string, block long, bucket long, vals binary")
    told = told.unionByName(words.select("kind", "block", "bucket", "vals")).repartition(block_partitions(blocks), "block")
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _score(depth, across, buckets, int(n_all), int(n_known)),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )
