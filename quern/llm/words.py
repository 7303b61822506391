"""Words, word hashes and word n-gram hashes straight from Arrow buffers.

A word is a maximal run of ASCII letters and digits and of code points from
U+0080, letters A-Z lower-cased: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. In UTF-8
that is a class of single bytes, so a whole batch is cut and hashed with a
handful of vector operations and no Python string is made.

Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
IS_WORD = np.zeros(256, bool)
for _a, _z in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IS_WORD[_a : _z + 1] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = U64(0xD6E8FEB86659FD93)
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        n = max(n, CHUNK)
        up, down = np.full(n, _BASE, U64), np.full(n, _BASE_INV, U64)
        up[0] = down[0] = 1
        _pow.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(col: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple:
    """A 64-bit hash of every word, and the n + 1 word offsets of the rows.

    With ``prefixes`` also an array for each: the hashes of the words' first so
    many bytes, 0 where a word is not longer.
    """
    data, offs = text_bytes(col)
    inner = offs[1:-1]
    parts, where, lo = [], [], 0
    heads: list[list[np.ndarray]] = [[np.zeros(0, U64)] for _ in prefixes]
    while lo < len(data):
        hi = min(lo + CHUNK, len(data))
        while hi < len(data):  # cut where no word is cut
            back = np.flatnonzero(~IS_WORD[data[max(lo, hi - 4096) : hi]])
            if len(back):
                hi = max(lo, hi - 4096) + int(back[-1]) + 1
                break
            hi = min(hi + CHUNK, len(data))
        b = data[lo:hi]
        m = IS_WORD[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        edge[inner[np.searchsorted(inner, lo) : np.searchsorted(inner, hi)] - lo] = True
        s = np.flatnonzero(m & (edge[:-1] | ~np.concatenate(([False], m[:-1]))))
        e = np.flatnonzero(m & (edge[1:] | ~np.concatenate((m[1:], [False])))) + 1
        up, down = _powers(len(b))
        c = np.empty(len(b) + 1, U64)
        c[0] = 0
        np.cumsum(_BYTE[b] * up[: len(b)], out=c[1:])
        parts.append(mix((c[e] - c[s]) * down[s]))
        for p, head in zip(prefixes, heads):
            longer = e - s > p
            head.append(np.where(longer, mix((c[np.minimum(s + p, e)] - c[s]) * down[s] + U64(p)), U64(0)))
        where.append(s + lo)
        lo = hi
    if not parts:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64), *(h[0] for h in heads)
    return np.concatenate(parts), np.searchsorted(np.concatenate(where), offs), *map(np.concatenate, heads)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes of single words, as :func:`word_hashes` gives them."""
    h, offs = word_hashes(pa.array([" ".join(words)], pa.string()))
    return h


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place; the last ``n - 1`` places have none."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, U64)
    g = h[:k].copy()
    for j in range(1, n):
        g *= _GRAM
        g += h[j : j + k]
    return mix(g)


def own_ngrams(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes that lie within one row, and the places (words of the batch) where they start."""
    g = ngrams(h, n)
    left = np.repeat(offs[1:], np.diff(offs))[: len(g)]
    at = np.flatnonzero(np.arange(len(g)) + n <= left)
    return g[at], at
