"""Words and rolling hashes of whole Arrow batches, computed with numpy over their bytes.

A batch is cut into slices of a few megabytes (never inside a document), so memory does not depend on the
batch size.  Hashes are polynomial modulo 2**64 over random byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = U64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


UP, DOWN = Powers(BASE), Powers(_inverse(BASE))
_values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=U64)
BYTE_VALUE = _values * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    return mix(h.astype(U64, copy=True))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Q with Q[e] - Q[s] = sum of values[i] * BASE**i over s <= i < e."""
    q = np.zeros(len(values) + 1, U64)
    np.cumsum(values * UP.upto(len(values)), out=q[1:])
    return q


def span_hash(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the sequences [start, end); equal sequences have equal hashes wherever they stand."""
    return mix((q[end] - q[start]) * DOWN.upto(len(q))[start])


@dataclass
class Slice:
    """Some documents of a batch: bytes, and where each one starts in them."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array, limit: int = SLICE, docs: int = 1 << 16) -> Iterator[Slice]:
    """The documents of an Arrow string column in slices of about ``limit`` bytes and at most ``docs``; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, first + docs, n)
        yield Slice(first, raw[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Mask of 256 with True for the bytes that separate words."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low:high + 1] = True
    return mask


#: Separators of the word patterns in use.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a slice: byte spans, document (index in the slice) and hash of each; first[d]: where document d's begin."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(piece: Slice, separators: np.ndarray, lower: bool = False) -> Words:
    """All words of a slice.  ``lower`` folds A-Z before splitting and hashing."""
    buf = LOWER[piece.buf] if lower else piece.buf
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    np.logical_not(separators[buf], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    bounds = piece.offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n)]
    begins[bounds] |= inside[bounds]
    start = np.flatnonzero(begins)
    # a word ends before a separator, before a document's end, or at the end of the bytes
    stops = inside[:n] & ~inside[1:]
    stops[bounds - 1] |= inside[bounds - 1]
    end = np.flatnonzero(stops) + 1
    first = np.searchsorted(start, piece.offsets)
    doc = np.repeat(np.arange(len(piece)), np.diff(first))
    h = span_hash(prefix_sums(BYTE_VALUE[buf]), start, end)
    for i in np.flatnonzero(end - start > 256):  # long words: a hash without known patterns of collision
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i]:end[i]].tobytes())
    return Words(start, end, doc, h, first)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word index) and hashes of all runs of ``size`` words within one document."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1:])
    q = prefix_sums(w.hash)
    return at, span_hash(q, at, at + size)
