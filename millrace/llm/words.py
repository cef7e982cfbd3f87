"""Words of whole Arrow text columns as numpy arrays: where they lie, what they hash to, how windows of them hash.

A word is a run of bytes other than space and \\x09-\\x0D. All functions are vectorised over a slice of documents,
so the cost per byte is a handful of numpy operations and the memory follows the slice, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps)
        if n > SLICE_BYTES * 2:  # one very long document is no reason to keep the table
            _powers.pop(str(base))
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a polynomial hash is usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of text, or of one document."""
    _, at = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(at, at[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a slice of documents: `starts` and `ends` in bytes; words of document d are first[d]:first[d + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False, spaces: np.ndarray = _SPACE):
        data, self.at = text_bytes(column)
        self.data = _LOWER[data] if lower else data
        n = len(self.data)
        inside = ~spaces[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            stops[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.at)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def docs(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self, beginning: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of at most the first `beginning` of them."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * _power(_BASE, n), out=sums[1:])
        ends = self.ends if beginning is None else np.minimum(self.ends, self.starts + beginning)
        h = (sums[ends] - sums[self.starts]) * _power(_INVERSE, n)[self.starts] if n else sums[:0]
        salt = 0 if beginning is None else beginning
        return mix(h + ((ends - self.starts) * 131 + salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_sums(hashes: np.ndarray) -> np.ndarray:
    """What `window_hashes` takes differences of."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=sums[1:])
    return sums


def window_hashes(
    hashes: np.ndarray, size: int | np.ndarray, sums: np.ndarray | None = None, starts: np.ndarray | None = None
) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, or of those that start at `starts`; document borders are the caller's matter."""
    n = len(hashes)
    if starts is not None:
        power = _power(_INVERSE, n)
        return mix((sums[starts + size] - sums[starts]) * power[starts] + np.asarray(size).astype(np.uint64))
    if n < size:
        return np.zeros(0, np.uint64)
    sums = hash_sums(hashes) if sums is None else sums
    return mix((sums[size:] - sums[:-size]) * _power(_INVERSE, n)[: n - size + 1] + np.uint64(size))


def whole_windows(words: Words, size: int) -> np.ndarray:
    """For each run of `size` words by first word: does it lie in one document?"""
    n = max(len(words) - size + 1, 0)
    last = np.repeat(words.first[1:], words.counts)
    return np.arange(n) + size <= last[:n]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` values."""
    if len(values) < size:
        return values[:0]
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
