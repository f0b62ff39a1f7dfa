"""Vectorised handling of texts in Arrow batches: words, their hashes, n-grams.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's 64-bit hash is a
polynomial over random byte values (differences of prefix sums, so no loop over words), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_VALUE[65:91] = _VALUE[97:123]
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_N = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i (mod 2**64) for i < n."""
    size = min(CHUNK + 1, 1 << n.bit_length()) if n <= CHUNK + 1 else n
    kept = max(_powers, default=0)
    if kept < size:
        both = []
        for p in (_P, _PINV):
            x = np.full(size, p, U64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size > CHUNK + 1:
            return both[0], both[1]
        _powers.clear()
        _powers[kept := size] = (both[0], both[1])
    return _powers[kept]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets of the rows in them); a null is an empty text."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = pc.fill_null(part.cast(pa.large_string()), "")
        n = len(part)
        if not n:
            continue
        _, off, data = part.buffers()
        off = np.frombuffer(off, np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


class Words:
    """starts, ends: byte positions of all words; first: for each text its first word's number, and at the end their count; hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SEP):
        n = len(data)
        sep = separators[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        word = ~sep
        begin = word.copy()
        begin[1:] &= sep[:-1] | edge[1:n]
        stop = word.copy()
        stop[:-1] &= sep[1:] | edge[1:n]
        self.data = data
        self.off = off
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, off)

    @property
    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U64)
        p, inverse = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_VALUE[self.data] * p[: len(self.data)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(U64) * _N[63])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words of an array of word hashes; entry i begins at word i. They also run across texts."""
    if len(words) < n:
        return np.zeros(0, U64)
    m = len(words) - n + 1
    out = words[:m] * _N[0]
    for i in range(1, n):
        out = out + words[i : m + i] * _N[i]
    return mix(out + U64(n))


def shingles(w: Words, n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles; of fewer words, the whole sequence as one."""
    h = w.hashes
    g = ngrams(h, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield ngrams(h[a:b], b - a)
        else:
            yield g[:0]
