"""Vectorised word and shingle hashing of Arrow string columns (used inside tasks).

Works on the UTF-8 bytes of a whole batch: word hashes come from one running sum of
weighted byte values, shingle hashes from mixing the hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

SHINGLE_WORDS = 4
CHUNK_BYTES = 1 << 20
_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1  # odd, so powers can be undone


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (two multiply-xorshift rounds)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@cache
def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += _U(32)
    return mix(lower + _U(0x1234567))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ROOT, -1, 1 << 64)
    up, down = np.full(n, _U(_ROOT)), np.full(n, _U(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column (nulls are empty)."""
    import pyarrow as pa

    a = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def collected(df) -> dict[str, np.ndarray]:
    """The columns of a small result as numpy arrays, without going through pandas."""
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _words(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every word."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ink = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    start = np.nonzero(ink & (edge[:-1] | ~np.concatenate([[False], ink[:-1]])))[0]
    end = np.nonzero(ink & (edge[1:] | ~np.concatenate([ink[1:], [False]])))[0] + 1
    n = max(CHUNK_BYTES * 2, 1 << int(len(raw)).bit_length())
    up, down = _powers(n) if n == CHUNK_BYTES * 2 else _powers.__wrapped__(n)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[raw] * up[:len(raw)])])
    h = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    return np.searchsorted(off, start, side="right") - 1, h


def _combine(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive word hashes."""
    n = len(w) - k + 1
    h = np.full(n, _U(k))
    for j in range(k):
        h = mix(h + w[j:j + n])
    return h


def _sets(off: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by (document, hash), and each document's offset."""
    docs = len(off) - 1
    owner, w = _words(off, raw)
    counts = np.bincount(owner, minlength=docs)
    keys, hashes = [], []
    if len(w) >= k:
        h = _combine(w, k)
        whole = owner[:len(h)] == owner[k - 1:]
        keys.append(owner[:len(h)][whole])
        hashes.append(h[whole])
    first = np.concatenate([[0], np.cumsum(counts)])
    for m in range(1, k):  # short documents: the whole sequence is one shingle
        own = np.nonzero(counts == m)[0]
        h = np.full(len(own), _U(m))
        for j in range(m):
            h = mix(h + w[first[own] + j])
        keys.append(own)
        hashes.append(h)
    key, h = np.concatenate(keys), np.concatenate(hashes)
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    key, h = key[fresh], h[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(key, minlength=docs))])


def shingle_sets(column, words: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first document, hashes, offsets)`` for runs of documents of bounded size."""
    off, raw = utf8(column)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, side="right")) - 1)
        hashes, cuts = _sets(off[a:b + 1] - off[a], raw[off[a]:off[b]], words)
        yield a, hashes, cuts
        a = b
