"""Byte-level BPE encoding and decoding with a local rank file.

Every match of the split pattern is encoded by itself, without special tokens, by the
tiktoken library. Long texts are first cut where the pattern always ends a match:

* before a blank or line feed that follows a character which isn't white space, since
  no alternative of the pattern runs from the latter into the former, and the only
  look-ahead of the pattern concerns runs of white space;
* between a letter and an ASCII character that is no letter, since letters only match
  in runs of letters, or at the end of an alternative;
* between an ideograph or kana and an ideographic or full-width stop, for the same reason.

So the pieces' tokens are those of the whole text. A stretch without such a place, as a
run of letters that is one match, is encoded whole. The work is one pass without a shuffle.

Defined results: null and empty texts have no tokens; repeated rows are encoded row by
row; an empty table gives an empty result. Only id and text are read. Decoding gives
bytes, which needn't be valid UTF-8 for ids that don't come from a text; an id outside
the vocabulary is an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a text is cut at the next safe place.
PIECE = 1 << 16

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[^\W\d_])(?=[!-@\[-`{-~])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[\u3001\u3002\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f])")


def read_ranks(path: str) -> bytes:
    """The rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        cut = next((m.start() for m in _CUT.finditer(text, start + size) if text[m.start() - 1].isalpha() or text[m.start()] in " \n"), None)
        if cut is None or cut <= start:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def encode(text: str | None, ranks: bytes, pattern: str, size: int = PIECE) -> list[int]:
    enc = encoding(ranks, pattern)
    return [i for p in pieces(text or "", size) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], ranks: bytes, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the tokens of every row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                ids = [encode(t.as_py(), ranks, pattern) for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(f, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids give null."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                raw = [None if x.as_py() is None else decode(x.as_py(), ranks, pattern) for x in part.column("ids")]
                yield pa.record_batch([part.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(f, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every row encoded, its ids decoded again, piece by piece."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        names = [str(i).encode() for i in range(enc.n_vocab)]
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for text in b.column("text"):
                count, left, right = 0, hashlib.sha256(), hashlib.sha256()
                for p in pieces(text.as_py() or ""):
                    ids = enc.encode_ordinary(p)
                    if ids:
                        left.update((b" " if count else b"") + b" ".join([names[i] for i in ids]))
                        right.update(enc.decode_bytes(ids))
                        count += len(ids)
                n.append(count)
                of_ids.append(left.hexdigest())
                of_bytes.append(right.hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(f, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
