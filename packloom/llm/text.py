"""Vectorised text work on Arrow batches: words, lines and hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240611))
#: A random odd number for each byte value, and the base of the polynomial with its inverse modulo 2 ** 64.
BYTE_HASH = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
#: The prime modulus 2 ** 61 - 1 of the hashes that stand for texts, and a random base.
PRIME = (1 << 61) - 1
PRIME_BASE = int(_rng.integers(1 << 32, PRIME))
#: Ranges of so many bytes and more are hashed by blake2b.
LONG_RANGE = 1 << 23
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k modulo 2 ** 64 for k below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit numbers."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, by halves of 31 and 30 bits, whose products fit 64 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    cross = a0 * b1 + a1 * b0
    return _folded(a1 * b1 * np.uint64(2) + (cross >> np.uint64(30)) + ((cross & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


def _power_list(base: int, n: int) -> np.ndarray:
    """base ** k modulo PRIME for k below n."""
    p = np.ones(1, np.uint64)
    while len(p) < n:
        p = np.concatenate([p, times(p[: n - len(p)], np.full(1, pow(base, len(p), PRIME), np.uint64))])
    return p


@functools.cache
def prime_powers() -> tuple[np.ndarray, np.ndarray]:
    """The low 30 and the high 31 bits of PRIME_BASE ** k modulo PRIME for k below BLOCK."""
    p = _power_list(PRIME_BASE, BLOCK)
    return (p & np.uint64((1 << 30) - 1)).astype(np.uint32), (p >> np.uint64(30)).astype(np.uint32)


def inverse_powers(k: np.ndarray) -> np.ndarray:
    """PRIME_BASE ** -k modulo PRIME, from two short lists."""
    if not len(k):
        return np.zeros(0, np.uint64)
    fine = _power_list(pow(PRIME_BASE, -1, PRIME), 1 << 10)
    coarse = _power_list(pow(PRIME_BASE, -(1 << 10), PRIME), int(k.max() >> 10) + 1)
    return times(fine[k & 1023], coarse[k >> 10])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text (or one row), the text bytes and the rows' offsets in them. Null: no bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system at a task's end: Spark keeps workers, and their memory adds up beside those that work."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Rolling:
    """Cheap hashes of any ranges, modulo 2 ** 64, where unequal strings of equal hashes are easily made: for choices that bytes are compared after."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_HASH[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + length * np.uint64(0xD6E8FEB86659FD93))

    def every(self, n: int) -> np.ndarray:
        """The hashes of all ranges of n bytes, from first to last."""
        sums = self.sums[n:] - self.sums[:-n]
        sums *= self.down[: len(sums)]
        sums += np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64))
        return mix(sums)


class Prefix:
    """Hashes that stand for any ranges of some bytes: polynomials modulo a prime, by differences of running sums.

    The sums of the low and the high halves wrap, but a range's own share of them, below 2 ** 40 a byte, does not.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.low, self.high = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
        for at in range(0, len(data), BLOCK):  # little memory beside the sums, also for a long text
            value = data[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
            low, high = (x[: len(value)] for x in prime_powers())
            if at:
                p = times(low + (high.astype(np.uint64) << np.uint64(30)), np.full(1, pow(PRIME_BASE, at, PRIME), np.uint64))
                low, high = p & np.uint64((1 << 30) - 1), p >> np.uint64(30)
            for sums, power in ((self.low, low), (self.high, high)):
                own = sums[at + 1 : at + 1 + len(value)]
                np.cumsum(value * power, out=own)
                own += sums[at]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        high = _folded(self.high[ends] - self.high[starts])
        shifted = ((high << np.uint64(30)) & np.uint64(PRIME)) | (high >> np.uint64(31))
        value = times(_folded(shifted + _folded(self.low[ends] - self.low[starts])), inverse_powers(starts))
        out = mix(value + length * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(length >= LONG_RANGE):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest())
        return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words from each word on, and whether those n words lie in one row."""
    out = np.zeros(len(hashes), np.uint64)
    inside = np.zeros(len(hashes), bool)
    if len(hashes) >= n:
        k = len(hashes) - n + 1
        for i in range(n):
            out[:k] = out[:k] * np.uint64(0xD1342543DE82EF95) + hashes[i : i + k]
        out[:k] = mix(out[:k])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside[:k] = row[:k] == row[n - 1 :]
    return out, inside


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles, A-Z lower-cased; with fewer words one for the whole sequence, without words none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = Prefix(data).of(starts, ends)
    all_windows, _ = windows(hashes, first, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(all_windows[a : b - n + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(0xD1342543DE82EF95) + h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
