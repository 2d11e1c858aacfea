"""Vectorised words, shingles and line hashes over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 1 << 64))
_Q = U(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are worked off at once; what is made of them on the way takes up to 50 times as much.
RUN_BYTES = 1 << 18
_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, RUN_BYTES + 2)
        a = np.full(size, _P, U)
        b = np.full(size, _PINV, U)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _lut(is_word) -> np.ndarray:
    """byte -> its lower case if it belongs to a word, else 0."""
    return np.array([(c + 32 if 65 <= c <= 90 else c) if is_word(c + 32 if 65 <= c <= 90 else c) else 0 for c in range(256)], np.uint8)


#: Words [^\x20\x09-\x0D]+, A-Z in lower case. A NUL byte belongs to a word and counts as byte 0xFF, which UTF-8 never uses.
SPACED = _lut(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D))
SPACED[0] = 255
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are in lower case.
ALNUM = _lut(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)


def chunks(col: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them) of runs of about limit bytes; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of rows: b (bytes as the table maps them), start and end in b, hash, first[i]:first[i+1] those of row i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> None:
        self.b = b = lut[buf]
        n = len(b)
        self.rows = len(offsets) - 1
        word = b != 0
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | begin[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | begin[1:n]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _powers(n + 1)
        c = np.zeros(n + 1, U)
        np.cumsum(b.astype(U) * power[:n], out=c[1:])
        self.hash = mix((c[self.end] - c[self.start]) * inverse[self.start])
        self.count = np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave the row are to be skipped by the caller."""
        h, n = self.hash, len(self.hash)
        if n < k:
            return np.zeros(0, U)
        g = h[: n - k + 1].copy()
        for j in range(1, k):
            g *= _Q
            g += h[j : n - k + 1 + j]
        return mix(g)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, joined by blanks."""
        return b" ".join(self.b[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def sequence_hash(h: np.ndarray) -> int:
    """Of a whole sequence of word hashes, with its length."""
    g = U(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            g = g * _Q + x
    return int(mix(np.array([g], U))[0])


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct k-word shingles; with fewer words the whole sequence as one; none without words."""
    g = w.grams(k)
    out = []
    for i in range(w.rows):
        a, n = int(w.first[i]), int(w.count[i])
        if n >= k:
            out.append(np.unique(g[a : a + n - k + 1]))
        elif n:
            out.append(np.array([sequence_hash(w.hash[a : a + n])], U))
        else:
            out.append(np.zeros(0, U))
    return out
