"""Character grams of many words at once, as 64-bit hashes, and tables that are looked up by them (task side)."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from loomstat.llm.common import strings
from loomstat.llm.shingles import FACTOR, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Spelled:
    """Words as code points, end to end. A gram's hash is a polynomial of its
    code points, mixed with its length; the whole word's is apart from all grams'."""

    def __init__(self, words: pa.Array):
        self.size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.points = np.frombuffer("".join(strings(words)).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.word = np.repeat(np.arange(len(self.size)), self.size)
        #: characters from here to the end of the word
        self.left = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(self.points))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and hash of every run of ``n`` characters."""
        at = np.flatnonzero(self.left >= n)
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total = total * FACTOR + self.points[at + k]
        return self.word[at], mixed(total + np.uint64(n))

    def whole(self) -> np.ndarray:
        """A hash of each word."""
        out = np.zeros(len(self.size), np.uint64)
        filled = self.size > 0
        if filled.any():
            power = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(int(self.size.max()), FACTOR)])  # wraps around, as the sums do
            out[filled] = np.add.reduceat(self.points * power[self.left], (np.cumsum(self.size) - self.size)[filled])
        return mixed(out + FACTOR)


def edged(words: pa.Array, left: str, right: str) -> pa.Array:
    """Words with a sign at either edge."""
    return pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (left, words, right, "")))


def hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots for distinct 64-bit keys: the key in each (0: free) and its place."""
    keys = np.maximum(keys, np.uint64(1))
    mask = np.uint64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
    held, place = np.zeros(int(mask) + 1, np.uint64), np.full(int(mask) + 1, -1, np.int32)
    left, step = np.arange(len(keys)), np.uint64(0)
    while len(left):
        slot = ((keys[left] + step) & mask).astype(np.int64)
        free = held[slot] == 0
        held[slot[free]] = keys[left[free]]  # of several, the last one stays
        mine = held[slot] == keys[left]
        place[slot[mine]] = left[mine]
        left, step = left[~mine], step + np.uint64(1)
    return held, place


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 for those not in the table."""
    held, place = table
    keys, mask = np.maximum(keys, np.uint64(1)), np.uint64(len(held) - 1)
    out, left, step = np.full(len(keys), -1, np.int64), np.arange(len(keys)), np.uint64(0)
    while len(left):
        slot = ((keys[left] + step) & mask).astype(np.int64)
        found = held[slot]
        hit = found == keys[left]
        out[left[hit]] = place[slot[hit]]
        left, step = left[~hit & (found != 0)], step + np.uint64(1)
    return out
