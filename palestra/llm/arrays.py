"""Words, windows and 64-bit hashes of many texts at once, on numpy arrays.

A slice of rows is seen as one byte array with the offsets of its texts, so that no
Python loop runs over words or bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**62)) * 4 + 3
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_WORD_BASE = int(_RANDOM.integers(0, 2**62)) * 4 + 3

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end last; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, content = column.buffers()
    if len(column) == 0 or content is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most ``limit`` bytes of text or of one row."""
    for batch in batches:
        _, offsets = joined(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = max(first + 1, min(last, batch.num_rows))
            yield batch.slice(first, last - first)
            first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes within each text, and the first
    run of each text with the number of runs last."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= ~inside[:-1]
    closes[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & opens)
    ends = np.flatnonzero(inside & closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, first word of each text."""
    return runs(~IS_SPACE[data], offsets)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Hasher:
    """Hashes of any byte ranges of one array from its prefix sums."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hasher._up) < n:
            Hasher._up, Hasher._down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        self._down = Hasher._down
        self._sums = np.zeros(n + 1, np.uint64)
        values = _BYTE_VALUES[data]
        values *= Hasher._up[:n]
        np.cumsum(values, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) == 0:
            return np.zeros(0, np.uint64)
        at = np.minimum(starts, len(self._down) - 1)
        found = (self._sums[ends] - self._sums[starts]) * self._down[at]
        return mixed(found + (ends - starts).astype(np.uint64))


    def windows(self, width: int) -> np.ndarray:
        """The same for every range of ``width`` bytes."""
        n = max(0, len(self._sums) - width)
        found = self._sums[width:] - self._sums[:n]
        found *= self._down[:n]
        found += np.uint64(width)
        return mixed(found)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` neighbours, over the borders of texts too."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        total += hashes[k : k + n] * np.uint64(factor)
        factor = factor * _WORD_BASE % 2**64
    return mixed(total)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: each row's group and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return group, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class SequenceHasher:
    """Hashes of any runs of one array of hashes from its prefix sums."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(SequenceHasher._up) < n:
            SequenceHasher._up = _powers(_WORD_BASE, n)
            SequenceHasher._down = _powers(pow(_WORD_BASE, -1, 2**64), n)
        self._down = SequenceHasher._down
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(hashes) * SequenceHasher._up[:n], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mixed(found + (ends - starts).astype(np.uint64))
