"""Code points and pre-token bounds of text blocks, vectorised.

``white_words`` cuts at Unicode white space. ``byte_level_bounds`` gives the bounds
of the pre-tokens of byte-level BPE (contractions; letters, digits or other signs
with one space before; white space). Characters whose class may differ between
Unicode versions mark their text as uncertain, for the tokenizer itself to cut.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from tidemark.llm.text import Block, _power_tables, mix

LETTER, DIGIT, SPACE, OTHER, UNSURE, EDGE = range(6)
#: Unicode's property White_Space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    out = np.full(0x110000, UNSURE, dtype=np.uint8)
    now, then = unicodedata.category, unicodedata.ucd_3_2_0.category
    for c in range(0x30000):
        x = chr(c)
        kind = now(x)
        if kind == then(x) and kind not in ("Cn", "Cs"):
            out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER
    out[list(WHITE)] = UNSURE
    out[0x1C:0x20] = UNSURE
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


@lru_cache(maxsize=1)
def white() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[list(WHITE)] = True
    return out


class Points:
    """The code points of a block, with the byte and the text at which each stands."""

    def __init__(self, block: Block):
        self.block = block
        self.points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if len(self.points) == len(block.data):
            self.byte = np.arange(len(self.points) + 1)
            self.offsets = block.offsets
        else:
            lead = (block.data & 0xC0) != 0x80
            self.byte = np.append(np.flatnonzero(lead), len(block.data))
            self.offsets = np.searchsorted(self.byte, block.offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    powers, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def white_words(points: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the runs without white space, and the first run of each text."""
    n = len(points.points)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~white()[points.points]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    cut = points.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[1:-1][cut]
    finishes[cut - 1] = inside[1:-1][cut - 1]
    start = np.flatnonzero(begins)
    return points.byte[start], points.byte[np.flatnonzero(finishes) + 1], np.searchsorted(start, points.offsets)


def byte_level_bounds(points: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the pre-tokens, the first one of each text, and which texts are uncertain."""
    p, n = points.points, len(points.points)
    kind = classes()[p]
    edge = np.zeros(n + 1, dtype=bool)
    edge[points.offsets] = True
    prev = np.concatenate([[np.uint8(EDGE)], kind[:-1]]) if n else kind
    prev[edge[:-1]] = EDGE
    after = np.concatenate([kind[1:], [np.uint8(EDGE)]]) if n else kind
    after[edge[1:]] = EDGE
    space = kind == SPACE
    last = space & (after != SPACE) & (after != EDGE)  # the white space right before a sign
    plain = np.zeros(n, dtype=bool)
    if n > 1:
        plain[1:] = last[:-1] & (p[:-1] == 32)
    begins = (kind != prev) & ~plain | last
    quote = np.flatnonzero((p == 39) & begins)
    if len(quote):
        ends = points.offsets[np.searchsorted(points.offsets, quote, side="right")]
        padded = np.concatenate([p, np.zeros(3, dtype=np.uint32)])
        a = np.where(quote + 1 < ends, padded[quote + 1], 0)
        b = np.where(quote + 2 < ends, padded[quote + 2], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for some, k in ((quote[one], 1), (quote[two & ~one], 2)):
            begins[some + 1] = False
            rest = some + 1 + k
            begins[rest[rest < n]] = True
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, points.offsets)
    unsure = np.zeros(points.block.n, dtype=bool)
    odd = kind == UNSURE
    if n > 1:
        odd[:-1] |= (p[:-1] == 60) & (p[1:] == 124)  # "<|" may begin a special token
    unsure[np.searchsorted(points.offsets, np.flatnonzero(odd), side="right") - 1] = True
    at = points.byte[start]
    return at, np.append(at[1:], len(points.block.data)), first, unsure
