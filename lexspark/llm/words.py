"""Words, hashes and sliding windows of whole Arrow batches, without a loop over words.

All texts of a slice lie in one byte buffer. Sums of values times powers of a base, modulo two primes
below 2**31, give the hash of any stretch of bytes as a difference of two sums; the same trick over word
hashes gives the hash of any stretch of words. (Modulo 2**64, as before, whole families of strings such
as Thue-Morse words collide for every base; modulo two primes, two different stretches of n values
collide with probability about (n / 2**31) ** 2.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
SLICE_BYTES = 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: two primes below 2**31: products of two residues fit in 64 bits, and prefix sums of residues do for 2**33 values
PRIMES = (2_147_483_647, 2_147_483_629)
_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo ``prime``, by doubling."""
    base %= prime
    known = _POWERS.get((base, prime))
    if known is None or len(known) < n:
        known = np.ones(1, dtype=np.uint64)
        while len(known) < n:
            known = np.concatenate([known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)])
        _POWERS[(base, prime)] = known
    return known[:n]


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """Prefix sums of values * base**i, one array per prime."""
    out = []
    for prime in PRIMES:
        p = np.uint64(prime)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values % p * _powers(base, len(values), prime) % p, out=sums[1:])
        out.append(sums % p)
    return tuple(out)


def _stretches(sums: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """One 64-bit hash of each stretch: its residues for both primes, side by side, then mixed."""
    parts = []
    for held, prime in zip(sums, PRIMES):
        p = np.uint64(prime)
        scale = _powers(pow(base % prime, -1, prime), int(starts.max()) + 1 if len(starts) else 0, prime)
        parts.append((held[ends] + p - held[starts]) % p * scale[starts] % p)
    return _mixed((parts[0] << np.uint64(32)) | parts[1])


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range of a buffer."""
    return _stretches(_sums(_BYTE_VALUES[data], BYTE_BASE), starts, ends, BYTE_BASE)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``; bytes of multi-byte characters all belong to words.
VISIBLE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


class Words:
    """The words of several texts: byte ranges, first word of each text, one hash per word."""

    def __init__(self, texts: pa.Array, members: np.ndarray = VISIBLE, lower: bool = False):
        self.offsets, self.data = buffers(texts)
        if lower:
            self.data = LOWERED[self.data]
        inside = members[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = self.offsets[:-1] < self.offsets[1:]
        heads, tails = self.offsets[:-1][full], self.offsets[1:][full] - 1
        begins[heads], ends[tails] = inside[heads], inside[tails]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a string or binary array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


class Sequences:
    """Hashes of any stretch of consecutive word hashes."""

    def __init__(self, hashes: np.ndarray, base: int = WORD_BASE):
        self.base, self.sums = base, _sums(hashes, base)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _stretches(self.sums, starts, ends, self.base)

    def windows(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each position on, whether or not they are of one text."""
        starts = np.arange(max(0, len(self.sums[0]) - length))
        return self.between(starts, starts + length)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from each position on."""
    held, span = values, 1
    while span * 2 <= width:
        held, span = np.minimum(held[:-span], held[span:]), span * 2
    rest = width - span
    return np.minimum(held[:-rest], held[rest:]) if rest else held


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text; a text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffers(batch.column(column))[0][1:]
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
