"""A minimal perfect hash of a fixed set of 64-bit codes: each code of the set gets its own number below the set's size.

Built in levels.  On each level the codes that are left are thrown onto twice as many bits; a bit that one code alone
hits is set and that code is done, the others go to the next level with another seed.  A code's number is the count of
set bits before its own.  Codes outside the set get some number too, or none: the caller compares what lies there.
"""

from __future__ import annotations

import numpy as np

from panelspark.llm.textkit import mix64

_U = np.uint64
#: Bits of a level for each code that is left.
ROOM = 2
LEVELS = 64


class PerfectHash:
    def __init__(self, codes: np.ndarray):
        codes = np.asarray(codes, _U)
        if len(np.unique(codes)) != len(codes):
            raise ValueError("the codes of a perfect hash must differ")
        self.size = len(codes)
        self.width: list[int] = []  # bits of each level
        bits = []
        left = codes
        while len(left):
            if len(bits) == LEVELS:
                raise ValueError("codes of a perfect hash collide on every level")
            width = ROOM * len(left)
            at = self._place(left, len(bits), width)
            hits = np.bincount(at, minlength=width)
            bits.append(hits == 1)
            self.width.append(width)
            left = left[hits[at] > 1]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits  # set bits before each
        self.begin = np.cumsum([0, *self.width])

    @staticmethod
    def _place(codes: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix64(codes + _U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % _U(width)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code; -1 for some that are not of the set."""
        codes = np.asarray(codes, _U)
        out = np.full(len(codes), -1, np.int64)
        live = np.arange(len(codes))
        for level, width in enumerate(self.width):
            at = self.begin[level] + self._place(codes[live], level, width)
            hit = self.bits[at]
            out[live[hit]] = self.before[at[hit]]
            live = live[~hit]
            if not len(live):
                break
        return out
