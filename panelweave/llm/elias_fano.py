"""Elias-Fano coding of ascending numbers, with select, in about 2 + log2(u / n) bits each."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(byte).count("1") for byte in range(256)], np.uint8)
# The place of every so many-th one is noted.
SAMPLE = 256


class EliasFano:
    """``n`` ascending numbers up to ``top``: low bits packed, high bits in unary.

    Number ``i`` sets bit ``high(i) + i`` of ``high``; ``select(i)`` finds it from
    the sample before it and counts ones by byte, so no table of offsets is held.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        top = int(values[-1])
        low_bits = max(0, (top // n).bit_length() - 1)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), 1, bitorder="little")
        low = np.packbits(bits[:, :low_bits].ravel(), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little").tobytes()
        samples = places[::SAMPLE].astype("<u4").tobytes()
        return cls(n, low_bits, low, high, samples)

    def all(self) -> np.ndarray:
        """Every number, for sequential reading."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(
            np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        )[: self.n]
        values = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(
                np.frombuffer(self.low, np.uint8),
                count=self.n * self.low_bits,
                bitorder="little",
            ).reshape(self.n, self.low_bits)
            values = values + bits @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return values

    def select(self, i: int) -> int:
        """Number ``i``, from the samples and at most a few bytes of each part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        byte, wanted = place // 8, i % SAMPLE
        held = self.high[byte] >> (place % 8) << (place % 8)
        while wanted >= _ONES[held]:
            wanted -= int(_ONES[held])
            byte += 1
            held = self.high[byte]
        for _ in range(wanted):
            held &= held - 1
        place = byte * 8 + (held & -held).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        start = i * self.low_bits
        held = int.from_bytes(self.low[start // 8 : (start + self.low_bits) // 8 + 1], "little")
        return (held >> (start % 8)) & ((1 << self.low_bits) - 1)
