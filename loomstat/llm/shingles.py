"""Word shingle sets as sorted 64-bit numbers (task side)."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle

from loomstat.llm.common import strings, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a finaliser of xor-shifts and odd factors)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text and a 64-bit number of each word; A-Z in lower case."""
    counts, index, words = words_of(pc.ascii_lower(texts.cast(pa.large_string())))
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(words)), np.uint64, len(words))
    return counts, each[index]


def shingle_numbers(counts: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text in order, repeats kept: row bounds and numbers.

    A text of fewer words than ``width`` has its whole sequence as one shingle;
    one without words has none.
    """
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.r_[0, np.cumsum(per)]
    first = np.r_[0, np.cumsum(counts)][:-1]
    at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], per)
    span = np.repeat(np.minimum(counts, width), per)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = k < span
        value = np.zeros(len(at), np.uint64)
        value[inside] = words[at[inside] + k]
        total = np.where(inside, total * FACTOR + mixed(value), total)
    return bounds, mixed(total + span.astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    bounds, numbers = shingle_numbers(*word_numbers(texts), width)
    return [np.unique(numbers[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
