"""Counting a whole vocabulary in texts, and cutting texts into the words of a vocabulary by their frequencies."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.automaton import MOST, Terms, sent
from tessera.scratch import stored

#: Different terms whose counts a task holds before it passes them on.
HELD = 200_000
#: Terms that are sent to the tasks at most, and characters of texts that a task puts into a block.
SENT, BLOCK = 100_000, 8_000_000
#: Characters of different runs whose substrings of a size are counted at once, and characters that are hashed at once.
PIECE, WINDOW = 4_000_000, 1 << 18
#: 64-bit words of the filter at most (32 MB), and the base of its hashes, an odd number.
MAYBE, BASE = 1 << 22, 0x9E3779B97F4A7C15
#: Costs are whole millionths, so that sums don't depend on their order.
UNIT = 1e6


def terms_of(vocab: DataFrame, column: str = "word") -> list[str]:
    """The distinct terms of a table that aren't null or empty; more than a task may hold are refused."""
    got = vocab.select(F.col(column).alias("w")).where("w <> ''").distinct().limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"more than {MOST} terms")
    return sorted(r["w"] for r in got)


def counts(rows: DataFrame, vocab: DataFrame, text: str = "text", column: str = "word") -> DataFrame:
    """(word, n_texts, n_places, n_apart) of the terms that occur: texts with it, places, and places left to right that don't overlap.

    Up to ``SENT`` terms are sent to the tasks, which find all in one walk along each text and pass on sums, one row a
    term. More of them stay a table, which the sums of the texts' substrings meet (``_joined``).
    """
    terms = stored(vocab.select(F.col(column).alias("word")).where("word <> ''").distinct())
    if terms.count() > SENT:
        return _joined(rows.select(F.col(text).alias("t")), terms)
    return _walked(rows.select(F.col(text).alias("t")), terms_of(terms))


def _walked(rows: DataFrame, terms: list[str]) -> DataFrame:
    """rows: (t), or (t, times) of texts that count several times."""
    get = sent(rows.sparkSession, terms)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = get()
        sums: dict[int, list[int]] = {}

        def out():
            cols = [pa.array([words.terms[k] for k in sums], pa.string()), *(pa.array([v[j] for v in sums.values()], pa.int64()) for j in range(3))]
            return pa.RecordBatch.from_arrays(cols, names=["word", "n_texts", "n_places", "n_apart"])

        for b in batches:
            often = b.column("times").to_pylist() if "times" in b.schema.names else [1] * len(b)
            for t, n in zip(b.column("t"), often, strict=True):
                for k, (every, apart, _) in words.counts(t.as_py() or "").items():
                    s = sums.setdefault(k, [0, 0, 0])
                    s[0] += n
                    s[1] += n * every
                    s[2] += n * apart
                if len(sums) > HELD:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    part = rows.mapInArrow(f, "word string, n_texts long, n_places long, n_apart long")
    return part.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n_texts", "n_places", "n_apart")))


def _joined(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for any number of terms: a table (word) of distinct ones.

    No term goes beyond a run of characters that terms are made of, so texts are cut into such runs. A task takes texts
    in blocks and looks at each different run of a block once: its substrings of the terms' lengths that may be terms
    (``_maybe``) are counted over the block's texts. Sums by substring are passed on, of which only terms are kept.
    """
    letters = {c for r in terms.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() for c in r["c"]}
    sizes = sorted(r["n"] for r in terms.select(F.length("word").alias("n")).distinct().collect())
    one = f"[{re.escape(''.join(sorted(letters)))}]"
    cut = re.compile(f"(?<!{one}){one}{{{sizes[0]},}}").findall
    maybe = rows.sparkSession.sparkContext.broadcast(_maybe(terms))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(maybe.value, np.uint64)
        block = _Block()
        for b in batches:
            for t in b.column("t").to_pylist():
                if block.held and block.held + len(t or "") > BLOCK:
                    yield from block.sums(sizes, bits)
                    block = _Block()
                block.add(cut(t or ""), len(t or ""))
        yield from block.sums(sizes, bits)

    part = rows.mapInArrow(f, "word string, n_texts long, n_places long, n_apart long")
    return part.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n_texts", "n_places", "n_apart"))).join(terms, "word")


def _code(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)


def _sums(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the characters before each place, weighted by powers of ``BASE``, and what takes the power of a place back (all modulo 2^64)."""
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(code), x, np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return np.r_[np.uint64(0), np.cumsum((code + np.uint64(1)) * up[:-1])], down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _bits(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash, which of so many words (a power of two) and three of its 64 bits."""
    one, low = np.uint64(1), np.uint64(63)
    mask = (one << (h & low)) | (one << (h >> np.uint64(6) & low)) | (one << (h >> np.uint64(12) & low))
    return (h >> np.uint64(65 - words.bit_length())).astype(np.int64), mask


def _maybe(terms: DataFrame) -> bytes:
    """A Bloom filter of the terms, 16 to 32 bits each and ``MAYBE`` words at most; a fuller one lets more pass, and no term is missed."""
    words = 1 << min(MAYBE.bit_length() - 1, max(4, (terms.count() // 4).bit_length()))
    part = min(words, 1 << 17)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 1000):
                each = b.column("word").slice(k, 1000).to_pylist()
                stops = np.cumsum([0, *map(len, each)])
                sums, down = _sums(_code(each))
                at, mask = _bits(_mixed((sums[stops[1:]] - sums[stops[:-1]]) * down[stops[:-1]]), words)
                yield pa.RecordBatch.from_arrays([pa.array(at // part, pa.int32()), pa.array(at % part, pa.int32()), pa.array(mask.view(np.int64))], names=["part", "at", "mask"])

    def g(rows: pa.Table) -> pa.Table:
        bits = np.zeros(part, np.uint64)
        np.bitwise_or.at(bits, rows["at"].to_numpy(), rows["mask"].to_numpy().view(np.uint64))
        return pa.table({"part": rows["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = bytearray(8 * words)
    for r in terms.select("word").mapInArrow(f, "part int, at int, mask long").groupBy("part").applyInArrow(g, "part int, bits binary").collect():
        bits[8 * part * r["part"] : 8 * part * (r["part"] + 1)] = r["bits"]
    return bytes(bits)


def _places(code: np.ndarray, left: np.ndarray, size: int, bits: np.ndarray, s: int, slices: int) -> Iterator[np.ndarray]:
    """Where substrings of a size begin that may be terms, of slice s by their hashes. left: characters to the end of a place's run."""
    for a in range(0, len(code) - size + 1, WINDOW):
        part = code[a : a + WINDOW + size - 1]
        i = np.flatnonzero(left[a : a + len(part) - size + 1] >= size)
        sums, down = _sums(part)
        h = _mixed((sums[i + size] - sums[i]) * down[i])
        if slices > 1:
            mine = (h >> np.uint64(18)) % np.uint64(slices) == s
            i, h = i[mine], h[mine]
        at, mask = _bits(h, len(bits))
        yield a + i[bits[at] & mask == mask]


class _Numbers(dict):
    """Numbers strings from 0 as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Block:
    """Texts of a task, as numbers of their runs."""

    def __init__(self):
        self.runs, self.ids, self.stops, self.held = _Numbers(), array("q"), [0], 0

    def add(self, runs: list[str], size: int) -> None:
        self.ids.extend(map(self.runs.__getitem__, runs))
        self.stops.append(len(self.ids))
        self.held += size + 1

    def sums(self, sizes: list[int], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """word, n_texts, n_places, n_apart of the substrings that may be terms."""
        n_texts = len(self.stops) - 1
        at = np.repeat(np.arange(n_texts), np.diff(self.stops))
        pairs, n = np.unique(np.frombuffer(self.ids, np.int64) * n_texts + at, return_counts=True) if len(at) else (at, at)
        run = pairs // max(1, n_texts)
        first = np.searchsorted(run, np.arange(len(self.runs) + 1))  # a run's pairs
        times = np.bincount(run, n, len(self.runs)).astype(np.int64)
        each = list(self.runs)
        lens = np.fromiter(map(len, each), np.int64, len(each))
        text, code = "".join(each), _code(each)
        of = np.repeat(np.arange(len(each)), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(text))
        slices = 1 + len(text) // PIECE
        for size in sizes:
            for s in range(slices):
                places = np.concatenate([np.empty(0, np.int64), *_places(code, left, size, bits, s, slices)])
                if len(places):
                    words = _Numbers()
                    word = np.fromiter(map(words.__getitem__, (text[i : i + size] for i in places.tolist())), np.int64, len(places))
                    yield _counted(words, word, places, of[places], size, times, first, pairs, n_texts)


def _counted(words: _Numbers, word: np.ndarray, places: np.ndarray, run: np.ndarray, size: int, times: np.ndarray, first: np.ndarray, pairs: np.ndarray, n_texts: int) -> pa.RecordBatch:
    """word, run: of each place. times: of each run. first, pairs: where a run's pairs begin, which are its number times n_texts plus a text's."""
    order = np.argsort(word, kind="stable")
    word, run, places = word[order], run[order], places[order]
    new_word, new = np.ones(len(word), bool), np.ones(len(word), bool)
    new_word[1:] = word[1:] != word[:-1]
    new[1:] = new_word[1:] | (run[1:] != run[:-1])
    free = np.ones(len(word), bool)  # places that don't overlap an earlier counted one of their run
    near = ~new
    near[1:] &= places[1:] - places[:-1] < size
    last = stop = -1
    for i in np.flatnonzero(near):
        if i - 1 != last:  # a place that overlaps none starts anew
            stop = places[i - 1] + size
        free[i] = places[i] >= stop
        if free[i]:
            stop = places[i] + size
        last = i
    heads = np.flatnonzero(new_word)
    n_places = np.add.reduceat(times[run], heads)
    n_apart = np.add.reduceat(times[run] * free, heads)
    word, run = word[new], run[new]  # from here on each word and run once
    lens = first[run + 1] - first[run]
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    seen = np.add.reduceat(lens, heads)
    several = np.diff(np.r_[heads, len(word)]) > 1
    if several.any():  # runs of one word can stand in one text
        of = np.repeat(several, np.diff(np.r_[heads, len(word)]))
        word, run, lens = word[of], run[of], lens[of]
        start = np.repeat(first[run] - (np.cumsum(lens) - lens), lens)
        key = np.repeat(word, lens) * n_texts + pairs[start + np.arange(len(start))] % n_texts
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        seen[several] = np.bincount(key // n_texts, minlength=len(words))[several]
    cols = [pa.array(list(words), pa.string()), *(pa.array(x.astype(np.int64)) for x in (seen, n_places, n_apart))]
    return pa.RecordBatch.from_arrays(cols, names=["word", "n_texts", "n_places", "n_apart"])


# --- segmentation ------------------------------------------------------------------------------


def costs(freq: Mapping[str, int]) -> dict[str, int]:
    """Words and what each costs: minus the logarithm of its share. What is no word costs as much as one that occurs once (the entry '')."""
    known = {w: max(1, n) for w, n in freq.items() if w}
    total = max(1, sum(known.values()))
    return {w: round(UNIT * math.log(total / n)) for w, n in known.items()} | {"": round(UNIT * math.log(total))}


class Lattice:
    """All ways to cut a text into words of a vocabulary, and the cheapest one."""

    def __init__(self, words: Terms, cost: Mapping[str, int]):
        self.words, self.cost, self.none = words, [cost[t] for t in words.terms], cost[""]

    def cut(self, text: str) -> list[str]:
        """The tokens of least cost in all; of equally cheap ways that with the longer first token, and so on.

        Words, and between them runs of Latin letters and digits, and single characters.
        """
        n = len(text)
        edges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, start, stop in self.words.places(text):
            edges[start].append((stop, self.cost[k]))
        best, to = [0] * (n + 1), [n] * (n + 1)
        run = n  # where the run of letters and digits ends that holds place i
        for i in range(n - 1, -1, -1):
            c = text[i]
            inner = c == "." or (c.isascii() and c.isalnum())
            if not inner or i + 1 == n or not (text[i + 1] == "." or (text[i + 1].isascii() and text[i + 1].isalnum())):
                run = i + 1
            low, far = self.none + best[run], run
            for stop, cost in edges[i]:
                if (new := cost + best[stop]) < low or (new == low and stop > far):
                    low, far = new, stop
            best[i], to[i] = low, far
        out, at = [], 0
        while at < n:
            out.append(text[at : to[at]])
            at = to[at]
        return out


def segmented(rows: DataFrame, cost: Mapping[str, int], text: str = "sentence") -> DataFrame:
    """rows plus ``tokens``, cut by ``Lattice``. cost: of ``costs``."""
    get = sent(rows.sparkSession, sorted(set(cost) - {""}))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(get(), cost)
        for b in batches:
            out = [lattice.cut(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names, "tokens"])

    return rows.mapInArrow(f, T.StructType([*rows.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))]))


def word_costs(rows: DataFrame, vocab: list[str], text: str = "sentence") -> dict[str, int]:
    """Costs of the words of a vocabulary by how often each occurs in the rows, once more than it does."""
    terms = sorted({w for w in vocab if w})
    each = rows.groupBy(F.col(text).alias("t")).agg(F.count("*").alias("times"))
    seen = {r["word"]: r["n_places"] for r in _walked(each, terms).collect()}  # no more rows than words
    return costs({w: 1 + seen.get(w, 0) for w in vocab})
