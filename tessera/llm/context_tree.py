"""Context-tree weighting over bytes, on numpy arrays; no Spark in this module.

A byte is decomposed into eight binary decisions. The decision reached after the
leading bits ``b1..bk`` is *node* ``1b1..bk`` (1..255), and every node owns a
context tree of depth ``D`` whose contexts are whole preceding bytes. A context of
depth ``d`` keeps the counts (zeros, ones) of its node and a Krichevsky-Trofimov
estimate of them; its weighted probability is half the estimate plus half the
product over its children, down to the leaves at depth ``D``.

After training, the probability that a frozen tree gives to the next bit is

    sum over d of  (product over j < d of (1 - w_j)) * w_d * KT_d

along the path of contexts, where ``w_d`` is the posterior weight of stopping at
depth ``d``. ``reach`` below is the running sum, ``rest`` the running product, so
that a context which training never saw costs ``reach + rest / 2``: the KT estimate
of no counts is one half.

Grams are ``D + 1`` bytes packed in an int64, the predicted byte lowest. Contexts reach
back ``across`` bytes whatever they are, and on to ``D`` only as far as the word goes that
holds the predicted byte (its leading space included); farther bytes are zero, and a chain
of contexts that only differ in them gives the same estimates as its first. A tree of
depth D splits into independent subtrees by the ``TOP`` bytes nearest to the
predicted one, which is what lets Spark build it in parts; ``tops`` joins them.
"""

from __future__ import annotations

import math

import numpy as np

DEPTH = 7
ACROSS = 6
#: Contexts of fewer bytes than this are weighted in one place: at most
#: (1 + 256) * 255 nodes, whatever the size of the corpus.
TOP = 2
END = 0xFF  # no UTF-8 text holds this byte

_SMALL = 4096
_HALF = np.array([math.lgamma(k + 0.5) for k in range(_SMALL)])
_WHOLE = np.array([0.0] + [math.lgamma(k) for k in range(1, _SMALL + 2)])
_LN2 = math.log(2.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; for arguments of 1000 and more, exact to double precision."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _lg(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    small = n < _SMALL - 1
    out = np.empty(len(n))
    out[small] = table[n[small] + (shift == 1.0)]
    out[~small] = _lgamma(n[~small] + shift)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the sequential KT probability of n0 zeros and n1 ones."""
    return _lg(n0, _HALF, 0.5) + _lg(n1, _HALF, 0.5) - _lg(n0 + n1, _WHOLE, 1.0) - math.log(math.pi)


def kt_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Natural log of the weighted probability of an inner context."""
    return np.logaddexp(log_kt(n0, n1), below) - _LN2


def stop_weight(n0: np.ndarray, n1: np.ndarray, log_pw: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(0.0, log_kt(n0, n1) - _LN2 - log_pw))


def stream(words: list[bytes]) -> bytes:
    """The bytes that are scored: words joined by a space, then the end mark."""
    return b" ".join(words) + b"\xff"


_MASKS = np.array([(1 << 8 * (k + 1)) - 1 for k in range(7)] + [-1], np.int64)


def grams_of(flat: np.ndarray, depth: int, across: int) -> np.ndarray:
    """The gram of every byte of ``flat`` but the first ``depth``, which are context only."""
    n = len(flat) - depth
    code = np.zeros(n, np.int64)
    for k in range(depth + 1):
        code <<= 8
        code |= flat[k : n + k]
    if across < depth:
        begins = (flat == 0x20) | (flat == END)
        near = np.zeros(n, bool)
        for k in range(1, depth):
            near |= begins[depth - k : n + depth - k]
            if k >= across:  # the word begins within k bytes: farther ones go
                code &= np.where(near, _MASKS[k], np.int64(-1))
    return code


def codes(streams: list[bytes], depth: int = DEPTH, across: int = ACROSS) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes of all streams one after the other, and where each stream starts.

    The context before a stream's first byte is made of end marks.
    """
    pad = b"\xff" * depth
    code = grams_of(np.frombuffer(pad + pad.join(streams), np.uint8), depth, across)
    sizes = np.array([len(s) for s in streams], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    keep = np.ones(len(code), bool)
    for k in range(depth):  # positions whose predicted byte is padding
        keep[starts[1:] + np.arange(len(starts) - 1) * depth + k] = False
    return code[keep], starts


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and how often each occurs. Sorts in place."""
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.append(first, len(code)))


def merge_counts(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order and the sums of their counts, for each kind of count."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    sums = (np.add.reduceat(np.concatenate(c)[order], first) if len(k) else np.zeros(0, np.int64) for c in counts)
    return k[first], *sums


def _nodes(grams: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each of the eight bits: (context << 8 | node), and the bit."""
    byte, context = grams & 0xFF, grams & ~np.int64(0xFF)
    keys, bits = [], []
    for k in range(8):
        keys.append(context | (np.int64(1) << k) | (byte >> (8 - k)))
        bits.append((byte >> (7 - k)) & 1)
    return keys, bits


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys & _MASKS[depth]


class Levels:
    """The contexts of depth ``top``..``depth`` that training counts reach, deepest first."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = TOP):
        self.depth, self.top = depth, top
        seen = counts > 0
        grams, counts = grams[seen], counts[seen]
        keys, bits = _nodes(grams)
        key = np.concatenate(keys) if keys else grams
        ones = np.concatenate([counts * b for b in bits])
        both = np.concatenate([counts] * 8)
        k, n, n1 = merge_counts([key], [both], [ones])
        n0 = n - n1
        self.keys, self.n0, self.n1, self.log_pw = {depth: k}, {depth: n0}, {depth: n1}, {depth: log_kt(n0, n1)}
        for d in range(depth - 1, top - 1, -1):
            short = _shorter(self.keys[d + 1], d)
            order = np.argsort(short)
            short = short[order]
            first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x[order], first) if len(first) else x[:0]  # noqa: B023, E731
            self.keys[d], self.n0[d], self.n1[d] = short[first], add(self.n0[d + 1]), add(self.n1[d + 1])
            self.log_pw[d] = weighted(self.n0[d], self.n1[d], add(self.log_pw[d + 1]))

    def log10_bytes(self, grams: np.ndarray, reach: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte. reach, rest: of the deepest
        context above ``top`` that training saw, as [byte before, node] arrays."""
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in range(self.top, self.depth + 1):
            keys = self.keys[d]
            node = keys & 0xFF
            if d == self.top:
                a, r = reach[(keys >> 8) & 0xFF, node], rest[(keys >> 8) & 0xFF, node]
            else:
                up = np.searchsorted(self.keys[d - 1], _shorter(keys, d - 1))
                a, r = got[d - 1][0][up], got[d - 1][1][up]
            w = stop_weight(self.n0[d], self.n1[d], self.log_pw[d]) if d < self.depth else np.ones(len(keys))
            got[d] = a + r * w * kt_one(self.n0[d], self.n1[d]), r * (1 - w)
        total = np.zeros(len(grams))
        keys, bits = _nodes(grams)
        for key, bit in zip(keys, bits, strict=True):
            one = np.empty(len(grams))
            left = np.arange(len(grams))
            for d in range(self.depth, self.top - 1, -1):
                have = self.keys[d]
                if not len(have) or not len(left):
                    continue
                short = _shorter(key[left], d)
                at = np.minimum(np.searchsorted(have, short), len(have) - 1)
                hit = have[at] == short
                one[left[hit]] = got[d][0][at[hit]] + got[d][1][at[hit]] / 2
                left = left[~hit]
            if len(left):
                node, before = key[left] & 0xFF, (key[left] >> 8) & 0xFF
                one[left] = reach[before, node] + rest[before, node] / 2
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total


def tops(byte: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """reach and rest of [byte before, node] after depths 0 and 1, from the rows of depth 1.

    below: sum of log_pw over the children at depth 2.
    """
    shape = (256, 256)
    c0, c1, kids = (np.zeros(shape, t) for t in (np.int64, np.int64, float))
    c0[byte, node], c1[byte, node], kids[byte, node] = n0, n1, below
    seen1 = c0 + c1 > 0
    flat = lambda f, *x: f(*(v.ravel() for v in x)).reshape(x[0].shape)
    pw1 = np.where(seen1, flat(weighted, c0, c1, kids), 0.0)
    r0, r1 = c0.sum(axis=0), c1.sum(axis=0)
    w0 = stop_weight(r0, r1, weighted(r0, r1, pw1.sum(axis=0)))
    seen0 = r0 + r1 > 0
    reach0, rest0 = np.where(seen0, w0 * kt_one(r0, r1), 0.0), np.where(seen0, 1 - w0, 1.0)
    w1 = flat(stop_weight, c0, c1, pw1)
    reach = np.where(seen1, reach0 + rest0 * w1 * kt_one(c0, c1), reach0)
    rest = np.where(seen1, rest0 * (1 - w1), rest0)
    return reach, rest
