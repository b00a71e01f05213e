"""Hashes of every word, byte range and word range of many texts at once, in numpy.

A range's hash is a polynomial over random values of its items, taken from one running sum, so
any range costs two look-ups. Two independent bases give 128 bits. Modulo 2^64 some long ranges
of two symbols (Thue-Morse) agree whatever the base: long words are therefore hashed whole, and
long byte ranges carry a second sum modulo a prime.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from shelfmark.llm.common import release, task_cache

#: Bytes of text hashed at once (one document is never split).
CHUNK = 1 << 20
U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PRIME = U64((1 << 31) - 1)
#: Words of so many bytes are hashed whole.
LONG_WORD = 32
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
TO_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE_VALUES = [mix(np.arange(1, 257, dtype=U64) * U64(b)) for b in BASES]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    name = f"powers:{base}"
    held = task_cache(name, lambda: {"n": 0})
    if held["n"] < n:
        size = max(n, CHUNK + 1)
        for key, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            row = np.full(size, b, U64)
            row[0] = 1
            held[key] = np.multiply.accumulate(row)
        held["n"] = size
    return held["up"], held["down"]


def _prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_powers`, modulo PRIME."""
    held = task_cache(f"prime-powers:{base}", lambda: {"n": 0})
    if held["n"] < n:
        size, p = max(n, CHUNK + 1), int(PRIME)
        for key, b in (("up", base % p), ("down", pow(base % p, -1, p))):
            row = np.ones(1, U64)
            while len(row) < size:
                row = np.concatenate([row, row * U64(pow(b, len(row), p)) % PRIME])
            held[key] = row[:size]
        held["n"] = size
    return held["up"], held["down"]


class Ranges:
    """Hashes of ranges [start, end) over a row of 64-bit values; `long` for ranges of hundreds
    of values and more."""

    def __init__(self, values: np.ndarray, base: int, long: bool = False):
        n = len(values)
        up, self.down = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])
        self.prime_sums = None
        if long:
            up, self.prime_down = _prime_powers(base, n + 1)
            self.prime_sums = np.zeros(n + 1, U64)
            np.cumsum((values >> U64(33)) * up[:n] % PRIME, out=self.prime_sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self.sums[end] - self.sums[start]) * self.down[start]
        if self.prime_sums is not None:
            rest = (self.prime_sums[end] - self.prime_sums[start]) % PRIME
            found = found ^ mix(rest * self.prime_down[start] % PRIME + U64(1))
        return mix(found)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each row starts."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, body = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of about CHUNK bytes."""
    release("bpe:")
    release("chunks:")
    data, at = buffers(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, data[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


class Words:
    """The words of a chunk: byte ranges, owning row, first word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a row ends any word
        edge[at] = True
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.first = np.searchsorted(self.start, at)  # per row, and one past the last
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)

    def hashes(self, data: np.ndarray, which: int = 0) -> np.ndarray:
        size = self.end - self.start
        found = Ranges(BYTE_VALUES[which][data], BASES[which]).hash(self.start, self.end)
        found += size.astype(U64)
        for k in np.flatnonzero(size >= LONG_WORD):
            found[k] = xxhash.xxh3_64_intdigest(data[self.start[k]:self.end[k]].tobytes(), which)
        return found


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value (the first of equals) in each full window of `width` values.

    Values are compared by their leading bits; the index fills the rest of the 64.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    bits = max(1, int(n).bit_length())
    mask = U64((1 << bits) - 1)
    least = (values & ~mask) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & mask).astype(np.int64)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and end of every run of rows that agree in all columns."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], n)


def squeeze(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def unsqueeze(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64) if x.flags.c_contiguous else np.ascontiguousarray(x).view(np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n items lie in one of the spans [start, end)."""
    change = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(
        ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0
