"""Vectorised words and hashes over many texts at once (numpy, no per-word Python).

A batch of texts is one byte array with document offsets.  Words are maximal
runs of bytes outside a separator set, so they equal regex words over the
decoded text whenever the set is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but 0-9, A-Z and a-z; A-Z are lowered before the cut.
ALNUM_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element-wise."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, m, dtype=np.uint64)]), dtype=np.uint64) for m in (_MUL, _INV))
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(blob: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of table[byte] * M^position over [i, j)."""
    s = np.empty(len(blob) + 1, dtype=np.uint64)
    s[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[blob] * powers(len(blob))[0], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from prefix_hash, alike wherever the bytes stand."""
    inv = powers(len(s))[1]
    with np.errstate(over="ignore"):
        return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))


def hash_spans(blob: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """span_hash of sorted disjoint spans, in pieces so that memory stays bounded."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + piece)))
        a, b = int(start[i]), int(end[j - 1])
        out[i:j] = span_hash(prefix_hash(blob[a:b]), start[i:j] - a, end[i:j] - a)
        i = j
    return out


class Words:
    """Words of a batch: start and end byte, 64-bit hash; doc d has words first[d]:first[d+1]."""

    def __init__(self, blob: np.ndarray, offsets: np.ndarray, separators: bytes = SPACE_SEPARATORS, lower: bool = False, hashes: bool = True):
        self.blob = _LOWER[blob] if lower else blob
        table = np.zeros(256, dtype=bool)
        table[list(separators)] = True
        word = np.zeros(len(blob) + 2, dtype=np.int8)
        word[1:-1] = ~table[self.blob]
        step = np.diff(word)
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(blob))]
        inner = inner[(word[inner] == 1) & (word[inner + 1] == 1)]
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        if len(inner):
            inner = np.unique(inner)
            self.start = np.sort(np.concatenate([self.start, inner]))
            self.end = np.sort(np.concatenate([self.end, inner]))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.hash = hash_spans(self.blob, self.start, self.end) if hashes else None

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def rolling(self, k: int, roll: np.uint64 = _ROLL) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one document; another ``roll`` gives another hash."""
        n = len(self.hash)
        m = max(0, n - k + 1)
        out = np.zeros(m, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * roll + self.hash[j : j + m]
        d = self.doc()
        return mix(out), d[:m] == d[k - 1 : k - 1 + m] if m else np.zeros(0, bool)


def blobs(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from, to, bytes, offsets) of a string column, about limit bytes each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
