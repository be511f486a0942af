"""SimHash near-duplicates by pivot distance tables.

Fingerprint: the words of a text with A-Z lower-cased, every run of ``width`` of them
joined by spaces and hashed by XXH64 with seed 42, repeats included; a bit is one if
more than half of the hashes have it. Documents link where at most two bits differ.

Pivot tables. Every distinct fingerprint gets its Hamming distances to ``PIVOTS``
reference fingerprints. Reference 0 is a random word ``p``; the others copy ``p`` and
differ from it in one sixteen-bit quarter only, ``PER_QUARTER`` of them a quarter. If
two fingerprints differ in at most two bits, then

* in two quarters at least they don't differ, so the differences between the distances
  to those quarters' references and the distance to ``p`` agree: those coordinates form
  the six join keys (one for each two quarters);
* no coordinate at all differs by more than two: pairs that share a key are discarded
  by their largest coordinate difference;
* what is left is verified on the fingerprints. Nothing is lost at any step.

Crowded keys. A key shared by more than ``CROWD`` distinct fingerprints isn't paired
up. Its members are linked through mid-points instead: two words differ in at most two
bits exactly if they share a word that is at most one bit away from both. As members of
a key agree in two quarters, each sends out itself and its 32 neighbours in the other
two, and shared mid-points link. Rows grow by 33 a member, whatever the crowd.

Copies are collapsed first: pairs and components are those of distinct fingerprints.

Defined results: null and empty texts have fingerprint zero, as have texts without
words, and link like any other; fewer than ``width`` words make one shingle of the
whole sequence; repeated rows link to each other; a null id is kept in the row and
never becomes a component id unless all of its component have none; empty tables give
empty results. Only id and text are read, so further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lower_words
from tessera.llm.components import components, forest

BITS = 2
PER_QUARTER = 12
CROWD = 64

_rng = np.random.default_rng(20)
_BASE = int(_rng.integers(0, 2**64, dtype=np.uint64))
#: References by quarter: the base with one quarter replaced.
REFERENCES = [[_BASE ^ (int(m) << 16 * q) for m in _rng.integers(1, 2**16, PER_QUARTER)] for q in range(4)]
PIVOTS = 1 + 4 * PER_QUARTER
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: str | None, width: int = 3) -> int:
    w = lower_words(text)
    if not w:
        return 0
    if len(w) <= width:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False)))
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 4096):
        part = np.array([h(s, 42) for s in shingles[at : at + 4096]], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _fingerprints(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [_signed(fingerprint(t.as_py(), width)) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("body"), pa.array(prints, pa.int64())], ["doc_id", "body", "print"])

    return f


def _body(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, body, print): a hash of the text, and the fingerprint's 64 bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _body(text_col).alias("body"))
    return rows.mapInArrow(_fingerprints(width), f"doc_id {kind}, body long, print long")


def distance(x: Column, reference: int) -> Column:
    return F.bit_count(x.bitwiseXOR(F.lit(_signed(reference))))


def pivot_table(prints: DataFrame) -> DataFrame:
    """For each print its distances to all references, as bytes: base, then quarter by quarter."""
    cells = [distance(F.col("print"), _BASE)] + [distance(F.col("print"), r) for q in REFERENCES for r in q]
    return prints.select("print", F.array(*(c.cast("byte") for c in cells)).alias("distances"))


def _key(pair: tuple[int, int]) -> Column:
    """The coordinates of two quarters, relative to the base's; packed in one long each."""
    d = F.col("distances")
    parts = []
    for q in pair:
        cells = [d[1 + q * PER_QUARTER + k].cast("long") - d[0].cast("long") + 16 for k in range(PER_QUARTER)]
        word = cells[0]
        for c in cells[1:]:
            word = word * 33 + c
        parts.append(word)
    return F.struct(F.lit(pair[0] * 4 + pair[1]).alias("quarters"), parts[0].alias("first"), parts[1].alias("second"))


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y): pairs of distinct prints that connect everything within two bits, directly or by way of others.

    prints: distinct ``print`` values.
    """
    table = pivot_table(prints)
    keyed = table.select("print", "distances", F.explode(F.array(*(_key(p) for p in _PAIRS))).alias("key")).select("print", "distances", "key.*")
    names = ["quarters", "first", "second"]
    keyed = scratch.table(keyed.select("print", "distances", *names))
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("members")).where("members > 1")
    sized = scratch.table(keyed.join(sizes, names))
    few = sized.where(F.col("members") <= CROWD)
    a, b = few.alias("a"), few.alias("b")
    same = [F.col(f"a.{n}") == F.col(f"b.{n}") for n in names]
    ahead = F.col("a.print") < F.col("b.print")
    near = F.array_max(F.zip_with("a.distances", "b.distances", lambda x, y: F.abs(x.cast("int") - y.cast("int")))) <= BITS
    exact = F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= BITS
    on = same[0] & same[1] & same[2] & ahead & near & exact
    pairs = a.join(b, on).select(F.col("a.print").alias("x"), F.col("b.print").alias("y"))

    # mid-points of crowded keys: flips in the two quarters that the key doesn't fix
    masks = {p[0] * 4 + p[1]: [0] + [_signed(1 << (16 * q + k)) for q in range(4) if q not in p for k in range(16)] for p in _PAIRS}
    flips = F.create_map(*(x for k, v in masks.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    mids = sized.where(F.col("members") > CROWD).select("print", "quarters", F.explode(flips[F.col("quarters")]).alias("flip"))
    mids = mids.select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("mid"), "quarters")
    low = mids.groupBy("quarters", "mid").agg(F.min("print").alias("y"), F.max("print").alias("top")).where("y < top").drop("top")
    shared = mids.join(low, ["quarters", "mid"]).where("print <> y").select(F.col("print").alias("x"), "y")
    return pairs.unionByName(shared).distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, print) of every row, and (p, root, component_id) of every distinct print."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs, id_col, text_col, width))
    # partial minima reach the shuffle: a fingerprint that most rows share costs one row a task
    distinct = scratch.table(prints.groupBy("print").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("print"), scratch), scratch)
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints, scratch.table(rooted.join(named, "root").select(F.col("print").alias("p"), "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints, classes = _rooted(docs, id_col, text_col, width)
    out = prints.join(classes, prints["print"] == classes["p"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _first_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with its columns: one row of each root, that with the smallest id (and hash of its text).

    rows: (doc_id, body, node) of docs, where the text decides the node; roots: (node, root), nodes without one
    are their own. Copies of a text meet as partial minima only.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    firsts = rows.groupBy("body", F.col("node").alias("n")).agg(first)
    named = firsts.join(roots, firsts["n"] == roots["node"], "left").select(F.coalesce("root", "n").alias("root"), "first", "body")
    best = F.min(F.struct("first.none", "first.doc_id", "body")).alias("best")
    kept = named.groupBy("root").agg(best).select(F.col("best.doc_id").alias("k"), F.col("best.body").alias("b"))
    twice = rows.groupBy("doc_id", "body").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("body").alias("h"), F.lit(True).alias("twice"))
    kept = kept.join(twice, kept["k"].eqNullSafe(twice["i"]) & (kept["b"] == twice["h"]), "left").select("k", "b", "twice")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), _body(text_col).alias("body"))
    out = row.join(kept, row["doc_id"].eqNullSafe(kept["k"]) & (row["body"] == kept["b"])).select("row", "doc_id", "body", "twice")
    repeated = out.where("twice").groupBy("doc_id", "body").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    out = out.where("twice IS NULL").select("row").unionByName(repeated)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with its columns: one row of each component of near_duplicates."""
    prints, classes = _rooted(docs, id_col, text_col, width)
    return _first_of_each(docs, prints.withColumnRenamed("print", "node"), classes.select(F.col("p").alias("node"), "root"), id_col, text_col)


# --- by similarity -----------------------------------------------------------------------
#
# Texts link if the Jaccard similarity of their sets of shingles is at least that asked for.
# Wide fingerprints (``WORDS`` words of 64 bits) and least hashes only find what to compare:
#
# 1. Candidates. Each of ``BANDS`` keys holds the least hashes of a text's shingles under
#    ``ROWS`` permutations: a pair shares a key with probability similarity ** ROWS, so that
#    one of exactly 0.8 shares none with 3e-5, whatever the number of texts and their lengths.
#    (Equal pivot coordinates can't be the keys here: similar texts differ in some 40 bits,
#    which leaves no group of coordinates unchanged.)
# 2. Pivot table. Every fingerprint that shares a key gets its distances to the
#    ``FAR_REFERENCES`` reference fingerprints. Each of the D bits in which a pair differs moves
#    a coordinate difference up or down by one, so differences grow with the root of D: pairs
#    whose largest one is beyond ``TURN`` roots of the bits expected are discarded. That drops
#    two thirds of unrelated pairs and, of sets of 100 shingles at 0.8, one in 4000. The
#    rest is discarded by a distance ``SPREAD`` standard deviations beyond the expected one.
# 3. Groups. The components of the candidate edges; similar texts are in one group. A task
#    writes one edge for each text, so a key with many members costs an edge a member.
# 4. Verification. In each group, the components under exact similarity of the sets of
#    shingles (as XXH64 hashes). Groups of over ``SLICE`` texts are cut into slices that share
#    the group's root; where that leaves a group in pieces, all pairs of its slices are
#    compared.
#
# A key of more than ``HOT`` members is dealt to as many tasks as it needs, and all pairs of
# its shares are compared, each in a task of its own: one member can't stand for a component,
# as others of it may be near to what that one isn't.
#
# Defined results: null and empty texts, and those without words, are alike; fewer than
# ``width`` words make one shingle of the whole sequence; of repeated rows one stays; rows
# without id come after all others; equal ids with different texts are told apart by the text;
# an empty table gives an empty result. Only id and text are read; columns come back as they are.

WORDS = 4
BANDS, ROWS = 20, 4
SPREAD = 4
#: By how much bits of small sets agree less often than the model says: most for 4 of 5 shingles, 0.8125 and not 0.8485.
SMALL_GAP = 0.0361
FAR_REFERENCES = 128
TURN = 4.25
#: Texts of a group that one task compares, and bytes of text, on average.
SLICE, SLICE_BYTES = 2048, 16 << 20
#: Members of a key that one task looks at.
HOT = 20_000
#: Members of a key up to which pairs are taken for all keys at once; beyond, key by key and breadth first. Both connect the same texts.
FEW = 4
#: Rows of keys that one task sorts, on average.
KEY_ROWS = 100_000

_EXPAND = np.random.default_rng(21).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = np.random.default_rng(23).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = np.random.default_rng(22).integers(0, 2**64, (FAR_REFERENCES, WORDS), dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the distinct shingles."""
    w = lower_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    shingles = {b" ".join(w)} if len(w) <= width else set(map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), np.uint64, len(shingles))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WORDS words: majority bits of the distinct shingles' hashes, each expanded to as many bits."""
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(h), 4096):
        for j, odd in enumerate(_EXPAND):
            m = (h[at : at + 4096] ^ odd) * odd
            m ^= m >> np.uint64(29)
            m *= np.uint64(0xBF58476D1CE4E5B9)
            m ^= m >> np.uint64(32)
            ones[j] += np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), axis=1).view(np.uint64).ravel()


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys: hashes of the least hashes under ROWS permutations each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        m = (h[at : at + 4096, None] ^ _PERMUTE) * _PERMUTE
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(29)
        least = np.minimum(least, m.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def agreement(similarity: float) -> float:
    """Probability that a bit agrees, for sets of that Jaccard similarity."""
    return 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi


def most_bits(similarity: float) -> int:
    """Distance up to which pairs are candidates: SPREAD standard deviations beyond the expected one of small sets."""
    n, p = 64 * WORDS, agreement(similarity) - SMALL_GAP
    return int(n * (1 - p) + SPREAD * np.sqrt(n * p * (1 - p)))


def most_turned(similarity: float) -> int:
    """Largest difference of pivot coordinates up to which pairs are candidates."""
    return int(TURN * np.sqrt(64 * WORDS * (1 - agreement(similarity) + SMALL_GAP)))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def far_table(prints: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to all references."""
    out = np.empty((len(prints), FAR_REFERENCES), np.int16)
    for k, r in enumerate(_FAR):
        out[:, k] = np.bitwise_count(prints ^ r).sum(axis=-1, dtype=np.int16)
    return out


def _near(prints: np.ndarray, table: np.ndarray, i: np.ndarray | int, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs are near: largest difference of pivot coordinates first, then the distance."""
    out = np.ones(len(j), bool)
    of = lambda k: i if isinstance(i, int) else i[k]
    left, turned = np.arange(len(j)), most_turned(similarity)
    for at in range(0, FAR_REFERENCES, 32):  # most unrelated pairs end with the first references
        off = (np.abs(table[of(left), at : at + 32] - table[j[left], at : at + 32]) > turned).any(axis=-1)
        out[left[off]] = False
        left = left[~off]
    out[left] = _apart(prints[of(left)], prints[j[left]]) <= most_bits(similarity)
    return out


def _key_edges(similarity: float):
    """Candidate edges (x, y) of the texts that share a share of a key; of hot keys also one member of each component."""

    def f(batches):
        import pandas as pd

        whole = [b for b in batches if len(b)]
        if not whole:
            return
        pdf = pd.concat(whole, ignore_index=True)
        key, part, name = (pdf[c].to_numpy(np.int64) for c in ("key", "part", "body"))
        order = np.lexsort((name, part, key))
        same = (key[order][1:] == key[order][:-1]) & (part[order][1:] == part[order][:-1])
        hot = pdf["hot"].to_numpy(bool)
        order = order[np.append(same, False) | np.append(False, same) | hot[order]]  # alone with a key: nothing to do
        key, part, name, hot = key[order], part[order], name[order], hot[order]
        if not len(order):
            return
        prints = np.frombuffer(b"".join(pdf["wide"].to_numpy()[order]), np.uint64).reshape(-1, WORDS)
        table = far_table(prints)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(first, len(key)))
        small = np.repeat(size <= FEW, size)
        group = np.repeat(np.arange(len(first)), size)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for gap in range(1, min(FEW, int(size.max()))):
            i = np.flatnonzero((group[:-gap] == group[gap:]) & small[gap:])
            if not len(i):
                break
            i = i[_near(prints, table, i, i + gap, similarity)]
            out.append((i, i + gap))
        for at, n in zip(first[size > FEW], size[size > FEW], strict=True):
            left, front = np.arange(at, at + n), []
            while len(left):
                if not front:
                    front, left = [int(left[0])], left[1:]
                x = front.pop()
                hit = _near(prints, table, x, left, similarity)
                out.append((np.full(int(hit.sum()), x), left[hit]))
                front += left[hit].tolist()
                left = left[~hit]
        x, y = (np.concatenate(c) for c in zip(*out, strict=True))
        # of what one task found, a text needs one edge only
        names, at = np.unique(np.concatenate([name[x], name[y]]), return_inverse=True)
        root = names[forest(len(names), at[: len(x)], at[len(x) :])]
        yield pd.DataFrame({"x": names[names != root], "y": root[names != root], "key": 0, "wide": None})
        if hot.any():
            tops = forest(len(name), x, y)  # of rows, key by key
            stay = np.flatnonzero(hot & (tops == np.arange(len(name))))
            yield pd.DataFrame({"x": name[stay], "y": name[stay], "key": key[stay], "wide": [prints[k].tobytes() for k in stay]})

    return f


def _candidates(distinct: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(x, y): edges that connect texts which share a key and are near. distinct: (body, wide, keys)."""
    keyed = distinct.mapInArrow(_keyed, "key long, body long, wide binary")
    total = distinct.count() * BANDS
    sizes = scratch.table(keyed.groupBy("key").count().where(F.col("count") > HOT).select(F.col("key").alias("k"), F.ceil(F.col("count") / HOT).alias("shares")))
    shared = keyed.join(sizes, keyed["key"] == sizes["k"], "left")
    part = F.pmod(F.xxhash64("body", "key"), F.coalesce("shares", F.lit(1)))
    rows = shared.select("key", "body", "wide", part.alias("part"), F.col("shares").isNotNull().alias("hot"), "shares")
    edges = scratch.table(_looked(rows.drop("shares"), total, similarity)).where("x <> y")
    if sizes.isEmpty():
        return edges.select("x", "y")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    pairs = rows.where("hot").withColumn("other", other).where("other <> part")
    pairs = pairs.select("key", "body", "wide", (F.least("part", "other") * F.col("shares") + F.greatest("part", "other")).alias("part"), F.lit(False).alias("hot"))
    more = scratch.table(_looked(pairs, pairs.count(), similarity))
    return edges.unionByName(more).select("x", "y")


def _looked(rows: DataFrame, total: int, similarity: float) -> DataFrame:
    parts = max(1, math.ceil(total / KEY_ROWS))
    return rows.repartition(parts, "key", "part").mapInPandas(_key_edges(similarity), "x long, y long, key long, wide binary")


def _similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the smallest index of its component, where sets of at least that Jaccard similarity link."""
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.split(ids, np.cumsum(size)[:-1])
    root, left, front, mark = np.arange(len(sets)), np.arange(len(sets)), [], np.zeros(len(ids) + 1, np.int64)
    flat, ends = ids, np.cumsum(size)
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
            flat, ends = np.concatenate([held[k] for k in left] or [ids[:0]]), np.cumsum(size[left])
        x = front.pop()
        mark[held[x]] = 1
        both = np.diff(np.concatenate([[0], np.cumsum(mark[flat])])[np.append(0, ends)])
        mark[held[x]] = 0
        # sets without words are alike
        hit = both >= similarity * (size[x] + size[left] - both) - 1e-9
        if hit.any():
            root[left[hit]] = root[x]
            front += left[hit].tolist()
            left = left[~hit]
            flat, ends = np.concatenate([held[k] for k in left] or [ids[:0]]), np.cumsum(size[left])
    return root


def _exact_edges(similarity: float, width: int):
    """Edges of truly similar texts, for rows (root, cut, body, text) of whole cuts of groups."""

    def f(batches):
        import pandas as pd

        whole = [b for b in batches if len(b)]
        if not whole:
            return
        pdf = pd.concat(whole, ignore_index=True)
        group, cut, name, text = (pdf[c].to_numpy() for c in ("root", "cut", "body", "text"))
        order = np.lexsort((name, cut, group))
        group, cut = group[order], cut[order]
        ends = np.flatnonzero(np.concatenate([(group[1:] != group[:-1]) | (cut[1:] != cut[:-1]), [True]])) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            at = order[a:b]
            root = _similar([shingle_hashes(text[k], width) for k in at], similarity)
            linked = root != np.arange(len(at))
            yield pd.DataFrame({"x": name[at][linked], "y": name[at][root[linked]]})

    return f


def _wide(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, keys = [], []
            for t in b.column("text"):  # the hashes of one text at a time
                h = shingle_hashes(t.as_py(), width)
                prints.append(wide_fingerprint(h).tobytes())
                keys.append(band_keys(h).tobytes())
            yield pa.record_batch([b.column("doc_id"), b.column("body"), pa.array(prints, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "body", "wide", "keys"])

    return f


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.frombuffer(b"".join(x.as_py() for x in b.column("keys")), np.int64)
        again = pa.array(np.repeat(np.arange(len(b)), BANDS))
        yield pa.record_batch([pa.array(found), b.column("body").take(again), b.column("wide").take(again)], ["key", "body", "wide"])


def _verified(base: DataFrame, firsts: DataFrame, groups: DataFrame, similarity: float, width: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the texts that truly similar ones connect.

    base: rows (doc_id, body, text); firsts: (body, first), one id of each text; groups: (node, root) of the candidates.
    """
    sizes = groups.groupBy("root").count().select(F.col("root").alias("r"), F.ceil(F.col("count") / SLICE).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    sized = groups.join(sizes, groups["root"] == sizes["r"]).select("node", "root", "cuts", cut.alias("cut"))
    sized = scratch.table(sized.join(firsts, sized["node"] == firsts["body"]).select("node", "root", "cuts", "cut", "first.doc_id"))
    # one row of each text in a group, by its id, so that neither copies nor other texts are shuffled
    texts = base.join(sized, (base["body"] == sized["node"]) & base["doc_id"].eqNullSafe(sized["doc_id"]))
    texts = texts.groupBy("root", "cuts", "cut", "body").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    texts = scratch.table(texts)
    edges_of = lambda cuts: scratch.table(
        cuts.repartition(max(1, math.ceil((cuts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SLICE_BYTES)), "root", "cut").mapInPandas(_exact_edges(similarity, width), "x long, y long")
    )
    mine = F.when(F.col("body") == F.col("root"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("cut"))
    edges = edges_of(texts.select("root", F.explode(mine).alias("cut"), "body", "text"))
    found = scratch.table(components(edges, scratch))
    many = sized.where("cuts > 1").select("node", F.col("root").alias("g"))
    pieces = many.join(found, "node", "left").groupBy("g", F.coalesce("root", "node").alias("piece")).count()
    torn = scratch.table(pieces.groupBy("g").agg(F.count("*").alias("pieces")).where("pieces > 1").select("g"))
    if torn.isEmpty():
        return found
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    pairs = texts.join(torn, texts["root"] == torn["g"]).select("root", "cut", "cuts", "body", "text", other)
    pairs = pairs.where("cuts = 2 OR other <> cut")
    both = F.least("cut", "other") * F.col("cuts") + F.greatest("cut", "other")
    return components(edges.unionByName(edges_of(pairs.select("root", both.alias("cut"), "body", "text"))), scratch)


def _similar_classes(docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body) of every row, and (node, root) of the texts that are connected to others."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _body(text_col).alias("body"))
    rows = scratch.table(base.mapInArrow(_wide(width), f"doc_id {kind}, body long, wide binary, keys binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    distinct = scratch.table(rows.groupBy("body").agg(F.min("wide").alias("wide"), F.min("keys").alias("keys"), first))
    near = scratch.table(_candidates(distinct.select("body", "wide", "keys"), similarity, scratch))
    groups = scratch.table(components(near, scratch))
    return rows.select("doc_id", "body"), _verified(base, distinct.select("body", "first"), groups, similarity, width, scratch)


def similar_rows(docs: DataFrame, similarity: float, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, root) of every row: rows with one root are copies, or connected by similar texts."""
    rows, roots = _similar_classes(docs, similarity, width, id_col, text_col)
    return rows.join(roots, rows["body"] == roots["node"], "left").select("doc_id", "body", F.coalesce("root", "body").alias("root"))


def keep_dissimilar(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns: one row of each group of similar texts."""
    rows, roots = _similar_classes(docs, similarity, width, id_col, text_col)
    return _first_of_each(docs, rows.withColumn("node", F.col("body")), roots, id_col, text_col)
