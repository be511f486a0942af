"""What the training-data operators share: scratch tables, document blocks, words.

*Scratch tables.* Several operators need an intermediate table more than once. They
write it as Parquet below ``spark.checkpoint.dir``, the folder that the driver and all
executors share, so that a lost executor costs the recomputation of tasks and never of
the whole lineage. Only where that setting is absent and Spark runs in one process (as
in tests) is a temporary folder used.

*Blocks.* A block is a set of documents, chosen by a hash of their id, with about
``BLOCK_BYTES`` of text. Statistics that concern every word, gram or window are first
gathered per block, so that a key which occurs in every document reaches the shuffle
once per block, packed with the block's other keys into one binary value.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20
#: While a table is written: the shuffle files of the write go with its end, and texts meet Python in smaller batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = getattr(spark, "_tessera_scratch", None)
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_scratch = path
        atexit.register(lambda: __import__("shutil").rmtree(path[7:], ignore_errors=True))
    return path


_open: list[Scratch] = []


@contextlib.contextmanager
def temporary():
    """What operators write to the shared folder within is removed at the end: write their results before."""
    mark = len(_open)
    try:
        yield
    finally:
        for s in _open[mark:]:
            s.remove()
        del _open[mark:]


class Scratch:
    """A folder of written tables. Results may read them, so whoever writes a result removes them (``temporary``)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", 0
        _open.append(self)

    def table(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written and read again; in a folder for each value of the column ``by``, if one is given."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        for k, v in _WRITING.items():
            conf.set(k, v)
        try:
            (df.write if by is None else df.write.partitionBy(by)).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._tessera_path)

    def remove(self) -> None:
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def block_partitions(blocks: int) -> int:
    """Shuffle partitions for that many blocks: more than blocks, so that few meet in one, up to a number that a shuffle of any size bears."""
    return min(3 * blocks, max(blocks // 64, 32_768))


def block_of(blocks: int, *key: str) -> Column:
    """Rows that agree in the whole key share a block; give id and text, so that rows of one id (or none) are spread."""
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("long")


def squeezed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text as UTF-8 bytes compressed row by row; null stays null. A shuffle of texts moves two thirds of what it would."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            at = b.schema.get_field_index(text)
            blobs = [None if (t := x.as_py()) is None else z.compress(t.encode("utf-8", "surrogatepass")) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    schema = T.StructType([T.StructField(c.name, T.BinaryType() if c.name == text else c.dataType) for c in docs.schema])
    return docs.mapInArrow(f, schema)


def unsqueezed(column: pa.ChunkedArray) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if (b := x.as_py()) is None else z.decompress(b) for x in column]


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; -1 where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def words(text: str | bytes | None) -> list[bytes]:
    """The maximal runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Bytes are UTF-8."""
    return _utf8(text).split()


def lower_words(text: str | bytes | None) -> list[bytes]:
    """words, with A-Z lower-cased and no other letter."""
    return _utf8(text).lower().split()


def _utf8(text: str | bytes | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Odd multipliers and start of each of two families of word hashes.
_MIX = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x2545F4914F6CDD1D)),
    (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)),
)
#: Bytes from which on a word is hashed by XXH3 instead of eight bytes at a time with others.
LONG_WORD = 64
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes flat[start:end]; equal runs have equal hashes. Two families.

    Eight bytes at a time are mixed in by multiplications and shifts that don't commute, so no pattern of letters makes
    runs collide (as sums of powers modulo 2**64 do), and runs of up to eight bytes that are of one length never collide.
    """
    a, b, first = _MIX[which]
    size = end - start
    out = (size.astype(np.uint64) * b) ^ first
    eight = np.ndarray(len(flat) + 1, "<u8", np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))
    rest = np.flatnonzero(size <= LONG_WORD)
    at, left, h = start[rest], size[rest], out[rest]
    while len(rest):
        h = (h ^ (eight[at] & _ENDS[np.minimum(left, 8)])) * a
        h = (h ^ (h >> np.uint64(32))) * b
        h ^= h >> np.uint64(29)
        out[rest] = h
        if not (more := left > 8).any():
            break
        rest, at, left, h = rest[more], at[more] + 8, left[more] - 8, h[more]
    if len(long := np.flatnonzero(size > LONG_WORD)):
        out[long] = [xxhash.xxh3_64_intdigest(flat[x:y].data, which) for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


#: A Mersenne prime; residues are below it.
PRIME = (1 << 61) - 1
_P, _LOW, _29 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
#: Two bases, whose powers make two families.
_BASES = (0x14057B7EF767814F, 0x0C6E7A5D3B2F1E97)
_tables: dict[tuple[int, bool], np.ndarray] = {}


def residues(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Residues a * b modulo PRIME, in halves of 32 bits: 2**61 is 1, so 2**64 is 8."""
    s32 = np.uint64(32)
    a1, a0, b1, b0 = a >> s32, a & _LOW, b >> s32, b & _LOW
    mid = a1 * b0 + a0 * b1
    low = a0 * b0
    return residues(((a1 * b1) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & _29) << s32) + (low & _P) + (low >> np.uint64(61)))


def powers(n: int, which: int = 0, back: bool = False) -> np.ndarray:
    """Powers of a base, or of its inverse, modulo PRIME."""
    have = _tables.get((which, back))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1 if back else 1, PRIME)
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 12):
            have = np.concatenate([have, product(have, np.uint64(pow(base, len(have), PRIME)))])
        _tables[which, back] = have
    return have[:n]


def window_sums(values: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The Rabin-Karp hashes, modulo PRIME, of the ``width`` values from each place on."""
    n, s32 = len(values), np.uint64(32)
    term = product(residues(values), powers(n, which))
    ends = []
    for half in (term >> s32, term & _LOW):  # halves, so that no sum exceeds 64 bits
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(half, out=sums[1:])
        ends.append(sums[at + width] - sums[at])
    high = residues(ends[0])
    value = (high >> np.uint64(29)) + ((high & _29) << s32) + residues(ends[1])
    return product(residues(value), powers(n, which, True)[at])


def spans(flat: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    inner = ~space[flat]
    return np.flatnonzero(inner & np.concatenate([[True], ~inner[:-1]])), np.flatnonzero(inner & np.concatenate([~inner[1:], [True]])) + 1


def word_hashes(texts: list[bytes], space: np.ndarray = SPACE, which: int = 0, piece: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word of the texts, in order, about ``piece`` bytes at a time; a word is never cut."""
    at: list[int] = []
    size = 0

    def hashed(rows, parts):
        flat = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
        start, end = spans(flat, space)
        ends = np.cumsum([len(p) + 1 for p in parts])
        return np.asarray(rows)[np.searchsorted(ends, start, side="right")], span_hashes(flat, start, end, which)

    for i, s in enumerate(texts):
        if len(s) > piece:
            off = 0
            while off < len(s):
                cut, step = off + piece, piece
                while cut < len(s) and not len(gap := np.flatnonzero(space[np.frombuffer(s, np.uint8, min(step, len(s) - cut), cut)])):
                    cut, step = cut + step, 2 * step
                cut = cut + int(gap[0]) + 1 if cut < len(s) else len(s)
                yield hashed([i], [s[off:cut]])
                off = cut
            continue
        at.append(i)
        size += len(s)
        if size > piece:
            yield hashed(at, [texts[j] for j in at])
            at, size = [], 0
    if at:
        yield hashed(at, [texts[j] for j in at])


def spread(keys: np.ndarray, parts: int) -> np.ndarray:
    """A part in 0..parts-1 for each 64-bit key."""
    k = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return ((k >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """An array as compressed byte planes: high bytes of sorted keys and of small counts all but vanish."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpack(blob: bytes, kind: type = np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def distinct(*keys: np.ndarray) -> np.ndarray:
    """The distinct values of all arrays, ascending; by sorting, which is faster here than hashing."""
    k = np.sort(np.concatenate(keys))
    return k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k


def by_part(keys: np.ndarray, parts: np.ndarray, *values: np.ndarray):
    """(part, keys, *values) for each part that has keys; order within a part is kept."""
    if not len(keys):
        return
    order = np.argsort(parts, kind="stable")
    p = parts[order]
    cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(p)], strict=True):
        pick = order[a:b]
        yield int(p[a]), keys[pick], *(v[pick] for v in values)
