"""Vectorised words and shingles over Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes of the UTF-8
text, with A-Z lower-cased. All work is done on blocks of a bounded number of
bytes (a block holds at least one text, however long), so memory follows the
block and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True

_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            _inverse_powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
    return _powers, _inverse_powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h *= _MIX_1
        h ^= h >> np.uint64(33)
        h *= _MIX_2
        h ^= h >> np.uint64(33)
    return h


class Block:
    """Consecutive texts: their bytes, and where each begins (``offsets`` has one more)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column (null: empty) into blocks of about ``limit`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    n, shift = len(column), column.offset
    if not n:
        return
    _, where, data = column.buffers()
    ends = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[shift : shift + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Block(i, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


class Words:
    """The words of a block: bounds in its bytes, the text of each, and 64-bit hashes."""

    def __init__(self, block: Block, hashes: bool = True):
        data, offsets = block.data, block.offsets
        is_word = np.zeros(len(data) + 2, dtype=bool)
        is_word[1:-1] = _IS_WORD[data]
        cut = offsets[1:-1]
        begins = is_word[1:-1] & ~is_word[:-2]
        finishes = is_word[1:-1] & ~is_word[2:]
        inner = cut[(cut > 0) & (cut < len(data))]
        begins[inner] = is_word[1:-1][inner]
        finishes[inner - 1] = is_word[1:-1][inner - 1]
        self.block = block
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finishes) + 1
        #: words of text i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            powers, inverse = _power_tables(len(data) + 1)
            with np.errstate(over="ignore"):
                value = _LOWER[data].astype(np.uint64)
                value += np.uint64(1)
                value *= powers[: len(data)]
                total = np.zeros(len(data) + 1, dtype=np.uint64)
                np.cumsum(value, out=total[1:])
                h = (total[self.end] - total[self.start]) * inverse[self.start]
                h += (self.end - self.start).astype(np.uint64) * _MIX_1
            self.hash = mix(h)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return _LOWER[self.block.data[self.start[i] : self.end[i]]].tobytes()


def shingles(words: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, text by text, and where each text's begin.

    With ``short``, a text of 1 to k-1 words has one shingle, of all its words.
    """
    h, first = words.hash, words.first
    n = len(h)
    counts = np.diff(first)
    keep = np.maximum(counts - k + 1, 0)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        for j in range(k if n >= k else 0):
            rolled *= _BASE
            rolled += h[j : n - k + 1 + j]
    few = (counts > 0) & (counts < k) if short else np.zeros(len(counts), dtype=bool)
    keep = keep + few
    starts = np.concatenate([[0], np.cumsum(keep)])
    out = np.empty(starts[-1], dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), keep)
    position = np.arange(len(out)) - starts[row] + first[:-1][row]
    full = ~few[row]
    out[full] = rolled[position[full]]
    for i in np.flatnonzero(few):
        total = 0
        for x in h[first[i] : first[i + 1]].tolist():
            total = (total * int(_BASE) + x) & 0xFFFFFFFFFFFFFFFF
        out[starts[i]] = np.uint64(total ^ int(counts[i]))
    return mix(out), starts


def encode(column: list[str | None]) -> pa.Array:
    return pa.array(column, type=pa.large_string())
