"""Vectorised text kernels shared by the operators: words, fingerprints, windows and slices of Arrow batches.

Every function works on numpy arrays of one slice of documents (a few MB), so memory stays bounded
whatever the partition holds. Fingerprints are 64-bit; their multipliers come from one fixed seed, so all
executors agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_GRAM = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words of letters and digits: all of ASCII but 0-9, A-Z and a-z.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join and cut batches at rows so that a slice holds about `most` bytes of the column; a longer row is alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1 - bool(held), int(np.searchsorted(at, at[start] + most - size, "right")) - 1)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(at[stop] - at[start])
            if stop < batch.num_rows or size >= most:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)
    tidy()


def tidy() -> None:
    """Give memory back at the end of a task: workers live on, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def bucket_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long, for arrays of longs."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    h = (turn(ids.astype(np.int64).view(U64) * p2, 31) * p1) ^ (U64(42 + 8) + p5)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return (h ^ (h >> U64(32))).view(np.int64)


def word_bounds(raw: np.ndarray, at: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and per row the index of its first word (one more entry at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~(inside[1:] & ~edge[1:-1]) if len(raw) > 1 else True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Bytes of words that are hashed at once, so that the temporary arrays fit the cache.
HASHED = 1 << 17


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A fingerprint of each word's bytes: a polynomial over values of the bytes, from prefix sums, then mixed."""
    out = np.zeros(len(starts), U64)
    table = _BYTE[_LOWER] if lower else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASHED, "right")))
        low = starts[i]
        if ends[j - 1] - low > HASHED:
            out[i] = _long_hash(raw[low : ends[i]], table)
        else:
            values = table[raw[low : ends[j - 1]]]
            up, down = _power(HASHED)
            values *= up[: len(values)]
            sums = np.zeros(len(values) + 1, U64)
            np.cumsum(values, out=sums[1:])
            s = starts[i:j] - low
            out[i:j] = (sums[ends[i:j] - low] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(U64))


def _long_hash(raw: np.ndarray, table: np.ndarray) -> np.uint64:
    """The same polynomial for a word of more than HASHED bytes, piece by piece."""
    total = 0
    up, _ = _power(HASHED)
    for at in range(0, len(raw), HASHED):
        piece = raw[at : at + HASHED]
        total += int((table[piece] * up[: len(piece)]).sum(dtype=U64)) * pow(int(_BASE), at, 1 << 64)
    return U64(total % (1 << 64))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every n consecutive values."""
    size = max(0, len(values) - n + 1)
    out = np.zeros(size, U64)
    for j in range(n):
        out += values[j : j + size] * _GRAM[j]
    return mix(out)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """For n items, the row each belongs to, given each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n, and those of its inverse; kept for the next call."""
    if len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(n + (n >> 2) + 1, base, U64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[name] = x
    return _powers["up"], _powers["down"]


class Rolling:
    """Fingerprints of any stretch of a sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        up, self.inverse = _power(len(values))
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U64))

    def every(self, n: int) -> np.ndarray:
        size = len(self.sums) - n
        if size <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[n:] - self.sums[:size]) * self.inverse[:size] + U64(n))


def lowest(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values."""
    out, have = values, 1
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def byte_units(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def spread(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are covered by the stretches."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches, one stretch after the other."""
    total = int(lengths.sum())
    heads = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - heads, lengths)
