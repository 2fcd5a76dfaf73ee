"""Vectorised word hashing over flat UTF-8 buffers.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased
text; every other ASCII character separates. All hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True

_P = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_tables: list[np.ndarray] = []

#: The same words by regular expression, for SQL engines with RE2.
WORD_RE2 = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        m = max(n, 1 << 16)
        _tables[:] = [np.cumprod(np.full(m, x, dtype=np.uint64)) for x in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64)))]
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, and for each document the number of its first word (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), np.zeros(len(offsets), np.int64)
    m = _IS_WORD[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _BLOCK)))
        lo, hi = starts[a], ends[b - 1]
        power, inverse = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        h[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return starts, ends, h, np.searchsorted(starts, offsets)


_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def trigrams(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of three words, first run of each document). A document of one or two words has one run, of all its words; one without words has none."""
    counts = np.diff(docs)
    g = h * _A
    g[:-1] += h[1:] * _B
    full = g[:-2] + h[2:] * _C if len(h) > 2 else g[:0]
    keep = np.zeros(len(h), bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    room = docs[1:][owner] - np.arange(len(h))
    keep[room >= 3] = True
    g[: len(full)][keep[: len(full)]] = full[keep[: len(full)]]
    one, two = docs[:-1][counts == 1], docs[:-1][counts == 2]
    g[one] = h[one] * _A + np.uint64(1)
    g[two] = h[two] * _A + h[two + 1] * _B + np.uint64(2)
    keep[one] = True
    keep[two] = True
    sizes = np.where(counts >= 3, counts - 2, np.minimum(counts, 1))
    return mix(g[keep]), np.concatenate([[0], np.cumsum(sizes)])
