"""All places of many terms in texts, in one walk along each text.

The terms are sent to the executors once (a broadcast value; callers check its size) and every
Python worker builds its automaton once, whatever number of tasks it runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Terms that a task may hold.
MOST = 500_000
_built: dict[str, Terms] = {}


class Terms:
    """An automaton of distinct terms that aren't empty; term k is the k-th of the list."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.a = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            self.a.add_word(t, k)
        if self.terms:
            self.a.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(term, start, stop) of all places, overlaps included, by their ends; of equal ends the longest first."""
        if self.terms:
            for last, k in self.a.iter(text):
                yield k, last + 1 - len(self.terms[k]), last + 1

    def counts(self, text: str) -> dict[int, list[int]]:
        """By term: the number of its places, of those that don't overlap an earlier counted one, and where that one ends."""
        out: dict[int, list[int]] = {}
        for k, start, stop in self.places(text):
            c = out.setdefault(k, [0, 0, 0])
            c[0] += 1
            if start >= c[2]:
                c[1] += 1
                c[2] = stop
        return out


def sent(spark: SparkSession, terms: Sequence[str]) -> Callable[[], Terms]:
    """A function that gives a worker its ``Terms``."""
    if len(terms) > MOST:
        raise ValueError(f"{len(terms)} terms; {MOST} at most")
    value, key = spark.sparkContext.broadcast(list(terms)), uuid.uuid4().hex

    def get() -> Terms:
        if key not in _built:
            if len(_built) > 8:
                _built.clear()
            _built[key] = Terms(value.value)
        return _built[key]

    return get


def with_places(rows: DataFrame, terms: Sequence[str], text: str = "sentence", first_only: bool = False) -> DataFrame:
    """rows plus (term, start, stop) for every place, or for the first place of each term; a null text has none."""
    get = sent(rows.sparkSession, sorted(set(terms) - {""}))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = get()
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, len(b), 256)):
                at: list[int] = []
                found: list[tuple[int, int, int]] = []
                for i, t in enumerate(part.column(text).to_pylist()):
                    new = list(words.places(t or ""))
                    if first_only:
                        new = list({k: (k, s, e) for k, s, e in reversed(new)}.values())
                    at += [i] * len(new)
                    found += new
                if at:
                    k, s, e = zip(*found, strict=True)
                    kept = part.take(pa.array(at, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([words.terms[x] for x in k]), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=[*part.schema.names, "term", "start", "stop"])

    more = [T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]
    return rows.mapInArrow(f, T.StructType([*rows.schema.fields, *more]))
