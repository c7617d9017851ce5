"""Elias-Fano sequences over byte buffers, queried in numpy without decoding them.

A rising sequence of n values below u keeps the low log2(u / n) bits of each value in a packed array and the high bits
as a unary bit vector; a directory of the ones before each 64-bit word finds the i-th one.
"""

from __future__ import annotations

import mmap

import numpy as np


def mapped(data: np.ndarray) -> np.ndarray:
    """The bytes of data in a memory map of their own (anonymous: no file is left on a machine)."""
    raw = data.tobytes()
    if not raw:
        return np.zeros(0, data.dtype)
    area = mmap.mmap(-1, len(raw))
    area.write(raw)
    return np.frombuffer(area, data.dtype)


class EliasFano:
    def __init__(self, values: np.ndarray, bound: int) -> None:
        """values: unsigned, rising; all below bound."""
        n = self.n = len(values)
        values = values.astype(np.uint64)
        self.width = l = min(56, max(0, (bound // max(n, 1)).bit_length() - 1))
        low = (values & np.uint64((1 << l) - 1)).view(np.int64)
        bits = np.zeros((n * l + 7) // 8 + 9, np.uint8)
        if l and n:
            for at in range(0, n, 65536):  # a multiple of 8 values ends on a byte
                part = low[at : at + 65536]
                packed = np.empty((len(part), l), np.uint8)
                for b in range(l):
                    packed[:, b] = part >> b & 1
                packed = np.packbits(packed.ravel(), bitorder="little")
                bits[at * l // 8 : at * l // 8 + len(packed)] = packed
        self.low = mapped(bits)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        unary[ones] = 1
        self.high = mapped(np.packbits(unary, bitorder="little").view(np.uint64))
        self.before = mapped(np.append(0, np.cumsum(np.bitwise_count(self.high).astype(np.int64))))

    def __len__(self) -> int:
        return self.n

    def select(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th one."""
        word = np.searchsorted(self.before, i, side="right") - 1
        left = i - self.before[word]
        bits, at = self.high[word], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = left >= ones
            left = np.where(up, left - ones, left)
            at += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), part)
        return word * 64 + at

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = (self.select(i) - i).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        bit = i * self.width
        window = np.ascontiguousarray(self.low[(bit >> 3)[:, None] + np.arange(8)]).view(np.uint64)[:, 0]
        return high | window >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.width) - 1)

    def values(self) -> np.ndarray:
        """All values in order: the ones of the high bits one after another, each with its low bits."""
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = np.arange(self.n) * self.width
            window = np.lib.stride_tricks.sliding_window_view(self.low, 8)
            for at in range(0, self.n, 1 << 18):
                part = bit[at : at + (1 << 18)]
                low = np.ascontiguousarray(window[part >> 3]).view(np.uint64)[:, 0]
                out[at : at + len(part)] |= low >> (part & 7).astype(np.uint64) & np.uint64((1 << self.width) - 1)
        return out

    def search(self, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
        """In each range [start, stop) the place of value, or -1."""
        low, high, found = start.copy(), stop.copy(), np.full(len(value), -1, np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = low[open_] + high[open_] >> 1
            here = self[mid]
            want = value[open_]
            hit = here == want
            found[open_[hit]] = mid[hit]
            less = here < want
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
            open_ = open_[~hit]
            open_ = open_[low[open_] < high[open_]]
        return found
