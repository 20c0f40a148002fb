"""Vectorised text primitives shared by the operators of this subpackage.

Texts reach Python as Arrow string arrays; everything here works on their
byte buffers with numpy, so that no Python object is made per document, word
or n-gram.  A *word* is a maximal run of ASCII letters and digits and of bytes
above 0x7F; every other byte separates words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = U64(0xD6E8FEB86659FD93)

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for every byte.
BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            self.up, self.down = (np.cumprod(np.r_[U64(1), np.full(size - 1, U64(b))]) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), offs


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of a range of documents; ``first`` has, per document, its first word's number (len+1)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def prefix_hash(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any slice follows, and inverse powers."""
    up, down = _POWERS.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=U64)
    np.cumsum(BYTE[b] * up[: len(b)], out=sums[1:])
    return sums, down


def slice_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def words(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, stem: int = 0) -> Words:
    """Words of the documents lo..hi, hashed from their bytes with ASCII and Latin-1 letters lowered.

    With ``stem``, each word ends after so many characters.
    """
    b = LOWER[data[offs[lo] : offs[hi]]]
    # capitals of Latin-1: C3 80..9E without 97
    b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)] += 32
    rel = offs[lo : hi + 1] - offs[lo]
    inside = WORD[b]
    before = np.zeros(len(b) + 1, dtype=bool)
    before[1:] = inside
    before[rel] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(b) + 1, dtype=bool)
    after[:-1] = inside
    after[rel] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, rel)
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    if stem and len(start):
        lead = (b & 0xC0) != 0x80
        leads = np.r_[np.flatnonzero(lead), np.full(stem, len(b))]
        end = np.minimum(end, leads[np.cumsum(lead)[start] - 1 + stem])
    sums, down = prefix_hash(b)
    return Words(doc, start, end, slice_hash(sums, down, start, end), first)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``size`` words; a shorter document has one run of all its words."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][doc]
    total = np.zeros(len(doc), dtype=U64)
    for k in range(size):
        total = total * _SHINGLE + w.hash[at + k]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        rest = np.zeros(len(short), dtype=U64)
        for k in range(size - 1):
            live = n[short] > k
            rest[live] = rest[live] * _SHINGLE + w.hash[w.first[:-1][short[live]] + k]
        doc, total = np.r_[doc, short], np.r_[total, rest + U64(1)]
        order = np.argsort(doc, kind="stable")
        doc, total = doc[order], total[order]
    return doc, mix(total)


#: Bytes of a document that are looked at together.
PIECE_BYTES = 1 << 20


def pieces(data: np.ndarray, lo: int, hi: int, size: int, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of the bytes lo..hi of one document; every run of ``size`` words lies whole in one of them."""
    if hi - lo <= limit:
        yield lo, hi
        return

    def next_gap(at: int) -> int:
        """End of the word that ``at`` lies in."""
        while at < hi:
            gap = np.flatnonzero(~WORD[data[at : at + 4096]])
            if len(gap):
                return min(hi, at + int(gap[0]))
            at += 4096
        return hi

    def next_word(at: int) -> int:
        while at < hi:
            word = np.flatnonzero(WORD[data[at : min(hi, at + 4096)]])
            if len(word):
                return at + int(word[0])
            at += 4096
        return hi

    start = lo
    while start < hi:
        cut = end = next_gap(min(hi, start + limit))
        for _ in range(size - 1):
            end = next_gap(next_word(end))
        yield start, end
        start = cut


def distinct_shingles(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of the shingles of documents lo..hi, sorted; each once a document and piece."""
    parts = list(pieces(data, int(offs[lo]), int(offs[hi]), size)) if hi - lo == 1 else []
    some = len(parts) <= 1
    for part in [*parts, None]:
        if part is None:
            # the whole range, unless its pieces have been looked at; a long text of few words has none
            if some and len(parts) > 1:
                continue
            w = words(data, offs, lo, hi)
        elif len(parts) == 1:
            continue
        else:
            w = words(data, np.array(part), 0, 1)
            if len(w.hash) < size:
                continue
            some = True
        doc, h = shingles(w, size)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield doc[new], h[new]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], type=pa.int32()), pa.array(values, type=kind))
