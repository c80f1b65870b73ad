"""Open-addressing map from 64-bit keys to row numbers, probed by whole arrays."""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class HashMap64:
    """Keys get numbers 0, 1, ... in the order they are added; key 0 counts as key 1."""

    def __init__(self, bits: int = 16):
        self._make(bits)
        self.n = 0

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        keys = np.maximum(keys, np.uint64(1))
        slots, last = self._slots(keys), len(self.keys) - 1
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & last
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not yet there."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            old, numbers = self.keys, self.values
            bits = self.bits
            while (self.n + len(keys)) * 2 > 1 << bits:
                bits += 1
            kept = np.flatnonzero(old)
            self._make(bits)
            self._put(old[kept], numbers[kept])
        self._put(np.maximum(keys, np.uint64(1)), np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slots, last = self._slots(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = numbers[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & last
