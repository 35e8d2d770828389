"""Whole-text kernels over Arrow string buffers, in numpy.

A batch of texts is one array of UTF-8 bytes with offsets. Words, lines and
their hashes come from passes over that array, without a Python loop over
words. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; UTF-8
keeps these bytes out of longer characters, so this equals
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_PRIME_INV = pow(_PRIME, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWER]

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << int(n).bit_length()
        for name, base in (("_powers", _PRIME), ("_inverses", _PRIME_INV)):
            steps = np.full(size + 1, base, dtype=U64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=U64)


class Texts:
    """Some consecutive texts: bytes and the bounds of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of True that stay in one text."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.bounds] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[edge[:-1]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def owners(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted starts: how many each text has, and each start's text."""
        at = np.searchsorted(starts, self.bounds)
        counts = np.diff(at)
        return counts, np.repeat(np.arange(len(self)), counts)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~IS_SPACE[self.data])

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, A-Z lower-cased if asked."""
        n = len(self.data)
        _grow(n)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[self.data] * _powers[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * _inverses[starts]
        return mix(found + (ends - starts).astype(U64))


def batches(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Cut a string column into pieces of about ``most_bytes``; one longer text is a piece of its own.

    Yields the piece's first and last row (exclusive) with its texts. Null is
    the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most_bytes, "right")) - 1)
        yield first, last, Texts(whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def ngram_hashes(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words within one text, with the index of the run's first word."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[size - 1 :] == owner[:m])
    total = np.full(len(at), size, dtype=U64)
    factor = 1
    for j in range(size):
        factor = factor * 0xFF51AFD7ED558CCD % (1 << 64)
        total += words[at + j] * U64(factor)
    return mix(total), at


def shingle_sets(texts: Texts, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles, lower-cased.

    A text with fewer words has its whole sequence as one shingle; a text
    without words has none.
    """
    starts, ends = texts.words()
    counts, owner = texts.owners(starts)
    words = texts.span_hashes(starts, ends, lower=True)
    grams, _ = ngram_hashes(words, owner, size)
    n_grams = np.maximum(counts - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(n_grams)])
    first = np.concatenate([[0], np.cumsum(counts)])
    for i in range(len(texts)):
        if n_grams[i]:
            own = np.sort(grams[at[i] : at[i + 1]])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif counts[i]:
            short, _ = ngram_hashes(words[first[i] : first[i + 1]], np.zeros(counts[i], np.int64), int(counts[i]))
            yield short
        else:
            yield np.zeros(0, U64)
