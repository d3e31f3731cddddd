"""Elias-Fano code of a non-decreasing sequence, with a select structure over its upper bits.

Each value's lower bits are stored as they are; its upper part is stored in unary in a bit array with
one bit set per value. Value i is then select(i) - i for the upper part: the place of the i-th set
bit, found from a table of every 64th (32 bits each, half a bit a value) and a scan of whole bytes.
About 2.5 + log2(u / n) bits a value; no table of whole offsets is kept or built to read one.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<QQB7x")


class EliasFano:
    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        if n + (universe >> low_bits) >= 2**32:
            raise ValueError("too many values for one code")
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Place of the i-th set bit of the upper array, from 0."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (here := bits.bit_count()) <= left:
            left, byte = left - here, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = i * self.low_bits
        low = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little") >> at % 8
        return (self.select(i) - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (upper << self.low_bits) + (bits << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)

    def to_bytes(self) -> bytes:
        return b"".join((_HEAD.pack(self.n, self.universe, self.low_bits), *(struct.pack("<Q", x.nbytes) + x.tobytes() for x in (self.low, self.high, self.samples))))

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> tuple[EliasFano, int]:
        """The code, and the number of bytes it took."""
        n, universe, low_bits = _HEAD.unpack_from(data)
        at, parts = _HEAD.size, []
        for kind in (np.uint8, np.uint8, "<u4"):
            size = struct.unpack_from("<Q", data, at)[0]
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
            at += 8 + size
        return cls(n, universe, low_bits, *parts), at
