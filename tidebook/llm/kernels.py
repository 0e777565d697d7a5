"""NumPy kernels over the UTF-8 bytes of Arrow string columns: word hashes, shingles, k-gram hashes.

Hashes are polynomials modulo 2**64 over random byte values, taken from prefix sums, so the hash of any
byte range costs two lookups and one product; a finaliser then mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, np.uint64))])
            _inv = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE_INVERSE, np.uint64))])
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on its (fresh) argument."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` bytes of text (or a single longer text): slice, bytes, offsets."""
    buf, off = utf8(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """C with C[i] = sum of the first i values times powers of the base."""
    n = len(values)
    pw, _ = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * pw[:n], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(c))
    with np.errstate(over="ignore"):
        return (c[end] - c[start]) * inv[start]


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the concatenated texts, and the n + 1 offsets of each text's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~table[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles, concatenated, and their n_texts + 1 offsets.

    Words are runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased. A text with fewer than n words
    has one shingle, its whole sequence; a text without words has none.
    """
    start, end, at = words(buf, off)
    with np.errstate(over="ignore"):
        h = mix(range_hash(prefix_hash(LOWER_VALUE[buf]), start, end) + (end - start).astype(np.uint64))
        full = np.zeros(len(h), np.uint64)
        m = len(h) - n + 1
        if m > 0:
            s = np.zeros(m, np.uint64)
            for j in range(n):
                s *= np.uint64(BASE)
                s += h[j : j + m]
            full[:m] = mix(s)
        out, sizes = [], np.zeros(len(off), np.int64)
        for i in range(len(off) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= n:
                x = full[a : b - n + 1].copy()
                x.sort()
                if len(x) > 1:
                    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:
                s = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    s = s * np.uint64(BASE) + h[j]
                x = mix(s)
            else:
                continue
            out.append(x)
            sizes[i + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
