"""Elias-Fano code of a rising sequence, with a select structure.

``n`` values up to ``top`` take ``2 + log2(top / n)`` bits each: the low bits are packed, the high bits
stand as gaps in a bit vector.  Positions of every ``STEP``-th one in that vector let :meth:`select`
find any value by counting ones in a few bytes.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QQBBQQ")  # n, top, low bits, bytes per sample, bytes of low and of high bits
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """``n`` values from 0 to ``top``, not falling."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits = n, top, low_bits
        self.low, self.high, self.samples = low, high, samples  # packed bits, packed bits, every STEP-th one

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max((top // n).bit_length() - 1, 0) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        vector = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        vector[ones] = 1
        return cls(n, top, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(vector, bitorder="little"), ones[::STEP].astype("<u4" if len(vector) < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.top, self.low_bits, self.samples.dtype.itemsize, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts at byte ``at``, and the byte behind it."""
        n, top, low_bits, wide, low, high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        count = -(-n // STEP)
        found = cls(n, top, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                    np.frombuffer(data, f"<u{wide}", count, at + low + high))
        return found, at + low + high + count * wide

    def select(self, i: int) -> int:
        """Value ``i``, from its sample on; no other value is unpacked."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // STEP])
        left = i % STEP + 1
        byte, mask = place >> 3, 0xFF << (place & 7) & 0xFF
        while True:
            ones = int(self.high[byte]) & mask
            count = int(_ONES[ones])
            if count >= left:
                break
            left, byte, mask = left - count, byte + 1, 0xFF
        for bit in range(8):
            left -= ones >> bit & 1
            if not left:
                break
        start = i * self.low_bits
        word = int.from_bytes(self.low[start >> 3:(start + self.low_bits + 7) >> 3].tobytes(), "little")
        return (byte * 8 + bit - i) << self.low_bits | word >> (start & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """All values."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high << self.low_bits | bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
