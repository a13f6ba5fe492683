"""Wavelet matrix over a sequence of symbols: packed bit-planes with rank and select.

Plane 0 holds the highest bit of every symbol in sequence order; each further plane holds the
next bit after a stable partition by the bit before. Rank is a counter per 64-bit word plus a
population count, select a binary search on the counters. All methods take arrays.
"""

from __future__ import annotations

import numpy as np

#: Head of the byte format: a mark, then number of planes and length as little-endian 64 bits.
_MARK, _HEAD_BYTES = b"WMATRIX1", 24


class WaveletMatrix:
    def __init__(self, planes: np.ndarray, length: int):
        """``planes``: one row of little-endian 64-bit words per bit, highest bit first."""
        self.planes, self.length = planes, length
        self.counts = np.zeros(planes.shape, dtype=np.int32)
        ones = np.bitwise_count(planes).astype(np.int32)
        np.cumsum(ones[:, :-1], axis=1, out=self.counts[:, 1:])
        self.zeros = length - (self.counts[:, -1] + ones[:, -1])

    @classmethod
    def build(cls, symbols: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        """``bits`` defaults to those of the largest symbol."""
        length = len(symbols)
        if bits is None:
            bits = max(int(symbols.max()).bit_length(), 1) if length else 1
        planes = np.zeros((bits, length // 64 + 1), dtype="<u8")
        for plane in range(bits):
            bit = symbols & symbols.dtype.type(1 << (bits - 1 - plane)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[plane].view(np.uint8)[: len(packed)] = packed
            symbols = np.concatenate([symbols.compress(~bit), symbols.compress(bit)])
        return cls(planes, length)

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.planes[plane][word] & below)
        return self.counts[plane][word] + inside.astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at positions."""
        at = np.asarray(at, dtype=np.int64)
        found = np.zeros(len(at), dtype=np.int64)
        for plane in range(len(self.planes)):
            word = self.planes[plane][at >> 6] >> (at & 63).astype(np.uint64)
            bit = (word & np.uint64(1)).astype(np.int64)
            ones = self._rank1(plane, at)
            found = (found << 1) | bit
            at = np.where(bit == 1, self.zeros[plane] + ones, at - ones)
        return found

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start = np.zeros(len(symbols), dtype=np.int64)
        at = np.asarray(at, dtype=np.int64)
        for plane in range(len(self.planes)):
            bit = (symbols >> (len(self.planes) - 1 - plane)) & 1 == 1
            ones, before = self._rank1(plane, at), self._rank1(plane, start)
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
            start = np.where(bit, self.zeros[plane] + before, start - before)
        return at - start

    def count(self, symbol: int) -> int:
        """Occurrences in the whole sequence."""
        if symbol >> len(self.planes):
            return 0
        return int(self.rank(np.array([symbol]), np.array([self.length]))[0])

    def _select_bit(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the n-th (from 0) set or clear bits of a plane."""
        counts = self.counts[plane].astype(np.int64)
        if bit == 0:
            counts = np.arange(len(counts), dtype=np.int64) * 64 - counts
        word = np.searchsorted(counts, nth, side="right") - 1
        inside = self.planes[plane][word] if bit else ~self.planes[plane][word]
        lanes = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        reached = np.cumsum(lanes, axis=1, dtype=np.int64) > (nth - counts[word])[:, None]
        return word * 64 + reached.argmax(axis=1)

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of a symbol, ascending."""
        found = self.count(symbol)
        if not found:
            return np.zeros(0, dtype=np.int64)
        start = np.zeros(1, dtype=np.int64)
        bits = [(symbol >> (len(self.planes) - 1 - p)) & 1 for p in range(len(self.planes))]
        for plane, bit in enumerate(bits):
            ones = self._rank1(plane, start)
            start = self.zeros[plane] + ones if bit else start - ones
        at = start[0] + np.arange(found, dtype=np.int64)
        for plane in reversed(range(len(bits))):
            nth = at - self.zeros[plane] if bits[plane] else at
            at = self._select_bit(plane, bits[plane], nth)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest bit."""
        symbols = np.zeros(self.length, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for plane in reversed(range(len(self.planes))):
            packed = self.planes[plane].view(np.uint8)
            bit = np.unpackbits(packed, count=self.length, bitorder="little").view(bool)
            back = np.empty_like(symbols)
            high = symbols.dtype.type(1 << (len(self.planes) - 1 - plane))
            back[np.flatnonzero(~bit)] = symbols[: self.zeros[plane]]
            back[np.flatnonzero(bit)] = symbols[self.zeros[plane] :] | high
            symbols = back
        return symbols

    def to_bytes(self) -> bytes:
        """Head and bit-planes; the rank counters are rebuilt on loading."""
        head = np.array([len(self.planes), self.length], dtype="<u8").tobytes()
        return _MARK + head + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[: len(_MARK)] != _MARK:
            raise ValueError("not a wavelet matrix")
        bits, length = np.frombuffer(data, dtype="<u8", offset=len(_MARK), count=2)
        planes = np.frombuffer(data, dtype="<u8", offset=_HEAD_BYTES).reshape(int(bits), -1)
        return cls(planes, int(length))
