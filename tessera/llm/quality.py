"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is
encoded (counts of character classes, word shapes and repetition, through one trained
layer), gets an attention weight from a tanh branch gated by a sigmoid branch, and the
weighted sum of the encodings is scored by a logistic layer:

    h_k = tanh(W x_k),  a = softmax_k(v . (tanh(T h_k) * sigmoid(S h_k))),  p = sigmoid(c . sum_k a_k h_k + b)

Only document labels train it. The fit takes a bounded sample of the labelled rows:
``max_docs`` by order of a hash of the id, and of each at most ``max_passages`` passages,
evenly spaced over the whole text. Scoring covers all rows and whole texts, whatever
their length, in one pass without a shuffle; the parameters, a few thousand numbers, go
along with the task. Texts beyond ``PIECE`` bytes are encoded part by part, with the words
and pairs of words seen so far carried along: the passages are the same as in one piece.

Defined results: null and empty texts are one empty passage; rows without a usable label
(null, unlabelled) are scored like others; an id with several labels counts as their
mean; repeated rows are scored row by row; if no label or only one kind is left, every
score is the share of label 1 (one half without labels); empty tables give empty
results. Only id, text and label are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, distinct, span_hashes, spans

PASSAGE = 96
MAX_FIT_DOCS = 4000
MAX_FIT_PASSAGES = 64
HIDDEN = 24
GATE = 16
EPOCHS = 150
#: Bytes of text that are encoded at once.
PIECE = 1 << 19

_CLASSES = 24
_class = np.full(256, 23, np.uint8)
_class[ord("a") : ord("z") + 1] = 0
_class[ord("A") : ord("Z") + 1] = 1
_class[ord("0") : ord("9") + 1] = 2
_class[0x80:] = 3
for _k, _chars in enumerate((b" \t\x0b\x0c", b"\n\r", b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"/", b"<>", b"()[]{}", b"'\"`", b"_-=+~^", b":;")):
    _class[list(_chars)] = 4 + _k
_END = re.compile(rb"[ \t-\r]")
#: Features of a passage: shares of character classes, then word shapes.
FEATURES = _CLASSES + 8


@dataclass
class Seen:
    """Hashes of the words and of the pairs of words that a text had so far, in ascending order."""

    words: np.ndarray
    pairs: np.ndarray


def _before(keys: np.ndarray, doc: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
    """Which keys the same text had before."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if seen is not None and len(seen):
        again |= seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] == keys
    return again


def passage_features(texts: list[bytes], seen: Seen | None = None, after: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features, bag): a row for each passage, and the text that it belongs to; each text has one passage at least.

    With ``seen``, ``texts`` is one part of a text, from the start of a passage; ``after`` is the word that follows it,
    if one does. What the part adds to ``seen`` is added.
    """
    n = len(texts)
    flat = np.frombuffer(b" ".join([*texts, b""]) if after is None else texts[0], np.uint8)
    sizes = np.array([len(t) + (after is None) for t in texts], np.int64)
    start, end = spans(flat)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, start, side="right")
    words_of = np.bincount(doc, minlength=n)
    first_word = np.cumsum(words_of) - words_of
    passages_of = np.maximum(1, -(-words_of // PASSAGE))
    first_passage = np.cumsum(passages_of) - passages_of
    total = int(passages_of.sum())
    word_passage = first_passage[doc] + (np.arange(len(start)) - first_word[doc]) // PASSAGE
    bag = np.repeat(np.arange(n), passages_of)
    # a character belongs to the passage of the last word that began, or to its text's first
    jump = np.zeros(len(flat), np.int64)
    jump[ends - sizes] = first_passage
    jump[start] = np.maximum(jump[start], word_passage)
    of = np.maximum.accumulate(jump)
    classes = np.bincount(of * _CLASSES + _class[flat], minlength=total * _CLASSES).reshape(total, _CLASSES)
    out = np.zeros((total, FEATURES))
    chars = np.maximum(1, classes.sum(axis=1))
    out[:, :_CLASSES] = classes / chars[:, None]
    count = np.bincount(word_passage, minlength=total)
    some = np.maximum(1, count)
    if len(start):
        length = end - start
        head, tail = flat[start], flat[end - 1]
        last = np.cumsum(_class[flat] == 1)
        upper = last[end - 1] - last[start] + (_class[head] == 1)
        mean = lambda x: np.bincount(word_passage, weights=x, minlength=total) / some
        out[:, _CLASSES + 0] = mean(np.minimum(length, 40) / 10)
        out[:, _CLASSES + 1] = mean(np.minimum(length, 40) ** 2 / 100)
        out[:, _CLASSES + 2] = mean((upper == length) & (length > 1))
        out[:, _CLASSES + 3] = mean(_class[head] == 1)
        out[:, _CLASSES + 4] = mean(_class[tail] >= 4)
        out[:, _CLASSES + 5] = mean((length == 1) & (_class[head] >= 4))
        word = span_hashes(flat, start, end)
        # shares of words, and of words that start a pair, that the same text had before
        out[:, _CLASSES + 6] = mean(_before(word, doc, seen and seen.words))
        follow = np.append(word[1:], np.uint64(0) if after is None else span_hashes(np.frombuffer(after, np.uint8), np.array([0]), np.array([len(after)])))
        first = np.flatnonzero(np.append(doc[1:] == doc[:-1], after is not None))
        pair = word[first] * np.uint64(0x9E3779B97F4A7C15) + follow[first]
        again = np.zeros(len(word), bool)
        again[first] = _before(pair, doc[first], seen and seen.pairs)
        out[:, _CLASSES + 7] = mean(again)
        if seen is not None:
            seen.words, seen.pairs = distinct(seen.words, word), distinct(seen.pairs, pair)
    return out, bag


def parts_of(raw: bytes, size: int) -> Iterator[tuple[bytes, bytes | None]]:
    """Parts of a text, of about ``size`` bytes, that end where a passage ends, each with the word that follows."""
    at = 0
    while True:
        step = size
        while True:
            flat = np.frombuffer(raw, np.uint8, min(step, len(raw) - at), at)
            space = SPACE[flat]
            start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            if at + step >= len(raw) or len(start) > PASSAGE:
                break
            step *= 2
        if at + step >= len(raw):
            yield raw[at:], None
            return
        cut = at + int(start[(len(start) - 1) // PASSAGE * PASSAGE])
        end = _END.search(raw, cut)
        yield raw[at:cut], raw[cut : end.start() if end else len(raw)]
        at = cut


def encode_texts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, features, bag) for a bounded part of the texts at a time; bag counts within rows.

    A text beyond ``PIECE`` comes alone, in parts that end with a passage; its bags come one after the other.
    """
    rows: list[int] = []
    part: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) > PIECE:
            seen = Seen(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            for piece, after in parts_of(raw, PIECE):
                f, bag = passage_features([piece], seen, after)
                yield np.array([i]), f, bag
            continue
        if size + len(raw) > PIECE and part:
            yield np.array(rows), *passage_features(part)
            rows, part, size = [], [], 0
        rows.append(i)
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield np.array(rows), *passage_features(part)


@dataclass
class Model:
    """Parameters of the network, with the mean and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention logits and encodings of passages."""
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.p["W"] + self.p["w0"])
        return (np.tanh(h @ self.p["T"]) * _sigmoid(h @ self.p["S"])) @ self.p["v"], h

    def score(self, texts: list[str | None]) -> np.ndarray:
        n = len(texts)
        if self.constant is not None:
            return np.full(n, self.constant)
        # running maximum, sum of weights and weighted sum: a text may come in parts
        top, weight, pooled = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        for rows, x, bag in encode_texts(texts):
            a, h = self.attend(x)
            first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
            new = np.maximum(top[rows], np.maximum.reduceat(a, first))
            fade = np.exp(top[rows] - new)
            e = np.exp(a - new[bag])
            weight[rows] = weight[rows] * fade + np.add.reduceat(e, first)
            pooled[rows] = pooled[rows] * fade[:, None] + np.add.reduceat(e[:, None] * h, first, axis=0)
            top[rows] = new
        return _sigmoid((pooled / np.maximum(weight, 1e-300)[:, None]) @ self.p["c"] + self.p["b"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """x: passages, with ascending bag numbers; y: the label of each bag."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, share)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "w0": np.zeros(HIDDEN), "T": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "S": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "v": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.array([np.log(share / (1 - share))])}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    cuts = np.searchsorted(bag, np.arange(n + 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = np.sort(order[at : at + 256])
            take = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in pick])
            b = np.repeat(np.arange(len(pick)), cuts[pick + 1] - cuts[pick])
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            q = z[take]
            h = np.tanh(q @ p["W"] + p["w0"])
            t, s = np.tanh(h @ p["T"]), _sigmoid(h @ p["S"])
            a = (t * s) @ p["v"]
            e = np.exp(a - np.maximum.reduceat(a, first)[b])
            a = e / np.add.reduceat(e, first)[b]
            pooled = np.add.reduceat(a[:, None] * h, first, axis=0)
            d_out = (_sigmoid(pooled @ p["c"] + p["b"][0]) - y[pick]) / len(pick)
            d_pool = d_out[:, None] * p["c"]
            d_a = (d_pool[b] * h).sum(axis=1)
            d_logit = a * (d_a - np.add.reduceat(a * d_a, first)[b])
            d_t, d_s = d_logit[:, None] * p["v"] * s * (1 - t**2), d_logit[:, None] * p["v"] * t * s * (1 - s)
            d_h = (a[:, None] * d_pool[b] + d_t @ p["T"].T + d_s @ p["S"].T) * (1 - h**2)
            g = {"W": q.T @ d_h, "w0": d_h.sum(axis=0), "T": h.T @ d_t, "S": h.T @ d_s, "v": (t * s).T @ d_logit, "c": pooled.T @ d_out, "b": np.array([d_out.sum()])}
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k in p:
                grad = g[k] + (1e-4 * p[k] if k != "b" else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def _bags(most: int):
    """Passages of each text as bytes, at most ``most``, evenly spaced."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                cells: list[list[np.ndarray]] = [[] for _ in range(len(part))]
                for rows, x, bag in encode_texts(part.column("text").to_pylist()):
                    for k, row in enumerate(rows):
                        cells[row].append(x[bag == k].astype(np.float32))
                bags = [np.concatenate(c) for c in cells]
                bags = [c[np.linspace(0, len(c) - 1, min(most, len(c))).astype(int)].tobytes() for c in bags]
                yield pa.record_batch([part.column("doc_id").cast(pa.string()), part.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bags"])

    return f


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_FIT_DOCS, max_passages: int = MAX_FIT_PASSAGES) -> Model:
    """Fits on the rows of docs that have a label and for whose id ``usable`` holds: ``max_docs`` rows, ``max_passages`` of each."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.avg("label").alias("label")).where(usable)
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    picked = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in sample], marked.schema))
    known = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "doc_id")
    # rows of repeated ids count once
    known = known.select("label", "text", "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = known.select("doc_id", "label", "text").mapInArrow(_bags(max_passages), "doc_id string, label double, bags binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bags"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES))
    return fit(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([float(r["label"] >= 0.5) for r in rows]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                yield pa.record_batch([part.column("doc_id"), pa.array(model.score(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(f, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with its columns, without the rows that the model scores below the threshold.

    Null and empty texts are scored as one empty passage; repeated rows and rows without id stay or go by their
    text alone; columns of any name pass through; an empty table stays empty.
    """
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(text)))

    return docs.where(score(F.col(text_col)) >= threshold)
