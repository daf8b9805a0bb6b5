"""Elias-Fano code of a non-decreasing sequence of non-negative integers, with select."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so many ones, the high bits' position of a one is kept for select.
SAMPLE = 256


@dataclass(frozen=True)
class EliasFano:
    """``n`` values up to ``top``: ``width`` low bits each, packed; the high parts in unary; select samples.

    Takes about ``n * (2 + log2(top / n))`` bits. Numbers are little-endian in every buffer.
    """

    n: int
    top: int
    width: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("Elias-Fano needs a non-decreasing sequence of non-negative values")
        top = int(v[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(width)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> width) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, top, width, low, np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        low = (bits.astype(np.int64) << np.arange(self.width)).sum(1) if self.width else np.zeros(self.n, np.int64)
        return (ones.astype(np.int64) - np.arange(self.n) << self.width) + low

    def select(self, i: int) -> int:
        """The value at place ``i``, from the sample before it and a scan of a few high bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.selects(np.array([i]))[0])

    def selects(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending ``places``: runs of places under one sample share its scan."""
        places = np.asarray(places, np.int64)
        samples, high = np.frombuffer(self.samples, "<u4"), np.frombuffer(self.high, np.uint8)
        ones = np.zeros(len(places), np.int64)
        for k in np.unique(places // SAMPLE).tolist():
            a, b = np.searchsorted(places, [k * SAMPLE, (k + 1) * SAMPLE])
            start = int(samples[k])
            stop = int(samples[k + 1]) if k + 1 < len(samples) else 8 * len(high)
            bits = np.unpackbits(high[start // 8 : stop // 8 + 1], bitorder="little")[start % 8 :]
            ones[a:b] = np.flatnonzero(bits)[places[a:b] - k * SAMPLE] + start
        # the low bits lie in at most eight bytes, as values have at most 56 bits
        low = np.zeros(len(self.low) + 8, np.uint8)
        low[: len(self.low)] = np.frombuffer(self.low, np.uint8)
        first = places * self.width
        word = np.zeros(len(places), np.uint64)
        for byte in range(8):
            word |= low[first // 8 + byte].astype(np.uint64) << np.uint64(8 * byte)
        word = word >> (first % 8).astype(np.uint64) & np.uint64((1 << self.width) - 1)
        return (ones - places << self.width) | word.astype(np.int64)

    def bits(self) -> int:
        return 8 * (len(self.low) + len(self.high) + len(self.samples))
