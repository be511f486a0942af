"""License scans: short notices in texts, with a bounded number of errors.

A text becomes its words in lower case, one space between: a notice may stand in any
punctuation and over any line breaks. A notice of n characters (UTF-8 bytes) may be found
with ``n // PER_EDIT`` insertions, deletions and substitutions, at most ``MAX_EDITS``, in a
span of whole words. *Seeds.* The notice is split into 2k + 2 pieces, of which k edits leave k + 2
unchanged (pigeonhole), shifted against each other by k at most. An Aho-Corasick automaton of
all pieces finds them; where so many meet, the notice can be. *Verification.* There the regex
library searches the best match with at most k errors, in a window that holds every match with
these pieces. *Spans.* Of matches that overlap the one with the fewest errors stays, then the
longest, then the first.

Exact phrases, each with a label, are found by the same automaton, at all places, overlaps included.

One pass without a shuffle. Texts go through in pieces of ``PIECE`` bytes whose ends
overlap, so memory is bounded whatever a text's length, and results are the same. The
notices are a parameter, ``license_notices.txt`` those of the query.

Defined results: a null text is empty, with no words, empty labels and score 0. Repeated
rows are scanned row by row; an empty table gives an empty result. Only id and text are
read. A text's score is that of its best place: 1 for a phrase, else 1 less the share of
edits among the notice's characters.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
#: Characters of a notice for each edit that is allowed, and the most edits.
PER_EDIT, MAX_EDITS = 12, 5
#: Bytes that no word holds, once A-Z are lower-cased: 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F.
_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Hit(NamedTuple):
    label: str
    start: int  # of the first word, from 0
    stop: int  # after the last word
    edits: int
    share: float  # of edits among the notice's characters
    text: str


def read_notices(path: str | Path = Path(__file__).with_name("license_notices.txt")) -> list[tuple[str, str]]:
    """(label, notice) of each line; lines that start with # and empty ones are left out."""
    return [tuple(line.split("\t", 1)) for line in Path(path).read_text("utf-8").splitlines() if line.strip() and not line.startswith("#")]


def plain(text: bytes) -> bytes:
    """The words of a text, lower-cased, each with a space behind it."""
    flat = np.frombuffer(text.lower(), np.uint8)
    if not len(flat):
        return b""
    gap = _GAP[flat]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return np.where(gap, np.uint8(32), flat)[keep].tobytes() + (b"" if gap[-1] else b" ")


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of some PIECE bytes, none of which ends within a word, and whether it is the last."""
    at = 0
    while True:
        cut, step = at + PIECE, 4096
        while cut < len(text):
            gaps = np.flatnonzero(_GAP[np.frombuffer(text[cut : cut + step].lower(), np.uint8)])
            if len(gaps):
                cut += int(gaps[0])
                break
            cut, step = cut + step, 2 * step
        yield text[at:cut], cut >= len(text)
        at = cut
        if at >= len(text):
            return


class Scanner:
    """Finds phrases exactly and notices with errors, both given as (label, text). Its strings hold a byte of UTF-8 as a character."""

    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]):
        norm = lambda t: plain(t.encode()).decode("latin-1").strip(" ")
        self.phrases = [(label, norm(t)) for label, t in phrases]
        self.notices = [(label, t, min(len(t) // PER_EDIT, MAX_EDITS)) for label, t in ((label, norm(t)) for label, t in notices) if t]
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}(?= )") for _, t, k in self.notices]
        found: dict[str, list[tuple[int, int]]] = {}  # (-1 - phrase, 0), or (notice, where the piece starts in it)
        for i, (_, t) in enumerate(self.phrases):
            if t:
                found.setdefault(f" {t} ", []).append((-1 - i, 0))
        for i, (_, t, k) in enumerate(self.notices):
            n = min(2 * k + 2, len(t))  # a notice of one letter is one piece
            cuts = [len(t) * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(t[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for word, whose in found.items():
            self.automaton.add_word(word, (len(word), whose))
        if found:
            self.automaton.make_automaton()
        #: Characters before or after the start of a match that may matter.
        self.reach = max([len(t) + 4 * k + 8 for _, t, k in self.notices] + [len(t) + 8 for _, t in self.phrases], default=8)

    def _windows(self, text: bytes) -> Iterator[tuple[str, int, int, int, bool]]:
        """(plain text, spaces before it, lo, hi, last): what starts at lo or later and before hi is to be looked for."""
        buf, before, lo = " ", 0, -self.reach
        for part, last in _pieces(text):
            buf += plain(part).decode("latin-1")
            hi = len(buf) if last else max(lo, len(buf) - self.reach)
            yield buf, before, lo, hi, last
            cut = max(0, hi - self.reach)
            before += buf.count(" ", 0, cut)
            buf, lo = buf[cut:], hi - cut

    def scan(self, text: bytes) -> tuple[int, list[Hit], list[tuple[str, int]]]:
        """The number of words, the spans of notices, and (label, first word) of all places of phrases."""
        hits: dict[tuple[int, int, int], tuple[int, str]] = {}
        places: list[tuple[str, int]] = []
        words = 0
        for buf, before, lo, hi, end in self._windows(text):
            exact, near = [], []
            seeds: dict[int, list[tuple[int, int]]] = {}  # notice: where it would start, and the piece
            for last, (size, whose) in self.automaton.iter(buf, max(0, lo)) if len(self.automaton) else ():
                x = last - size + 1
                for i, off in whose:
                    if i >= 0:
                        seeds.setdefault(i, []).append((x - off, off))
                    elif lo <= x < hi:
                        exact.append((x + 1, self.phrases[-1 - i][0]))
            for i, where in seeds.items():
                _, t, k = self.notices[i]
                for start in self._together(where, k, min(k + 2, len(t))):
                    low = max(0, start - k - 1)
                    if lo <= start < hi and (m := self.patterns[i].search(buf[low : max(0, start + len(t) + 2 * k + 1)])):
                        near.append((i, low + m.start(), low + m.end(), sum(m.fuzzy_counts), m.group()))
            at, count, number = 0, before - 1, {}
            for p in sorted({p for p, _ in exact} | {p for h in near for p in h[1:3]}):
                count += buf.count(" ", at, p)
                at, number[p] = p, count
            places += [(label, number[p]) for p, label in exact]
            hits |= {(i, number[a], number[b] + 1): (e, found) for i, a, b, e, found in near}
            words = before + buf.count(" ") - 1 if end else words
        return words, self._apart(hits), places

    @staticmethod
    def _together(where: list[tuple[int, int]], k: int, least: int) -> Iterator[int]:
        """Starts from which on so many different pieces stand within k places."""
        where.sort()
        before = None
        for j in range(len(where) - least + 1):
            start = where[j][0]
            if start != before and where[j + least - 1][0] <= start + k and len({off for _, off in where[j : bisect.bisect(where, (start + k + 1,))]}) >= least:
                yield start
            before = start

    def _apart(self, hits: dict[tuple[int, int, int], tuple[int, str]]) -> list[Hit]:
        kept: list[Hit] = []
        starts: list[int] = []
        for (i, a, b), (edits, found) in sorted(hits.items(), key=lambda h: (h[1][0], h[0][1] - h[0][2], h[0][1], h[0][0])):
            at = bisect.bisect(starts, a)
            if (at and kept[at - 1].stop > a) or (at < len(kept) and kept[at].start < b):
                continue
            label, t, _ = self.notices[i]
            starts.insert(at, a)
            kept.insert(at, Hit(label, a, b, edits, edits / len(t), found.encode("latin-1").decode("utf-8", "replace")))
        return kept


_SPANS = "array<struct<label:string,start:bigint,stop:bigint,edits:int,share:double,text:string>>"


def scan_documents(docs: DataFrame, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, places): spans of notices (those of the file if None), and places (label, start) of phrases; words count from 0."""
    notices = read_notices() if notices is None else notices

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("share", pa.float64()), ("text", pa.string())]))
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        for b in batches:
            rows = [scanner.scan((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
            columns = [
                pa.array([n for n, _, _ in rows], pa.int64()), pa.array([[h._asdict() for h in hs] for _, hs, _ in rows], span),
                pa.array([[{"label": label, "start": p} for label, p in ps] for _, _, ps in rows], place),
            ]
            yield pa.record_batch([b.column("doc_id"), *columns], ["doc_id", "n_words", "spans", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(f, f"doc_id {kind}, n_words long, spans {_SPANS}, places array<struct<label:string,start:bigint>>")


def license_digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of what ``scan_documents`` returns."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    best = F.coalesce(1 - F.array_min(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
