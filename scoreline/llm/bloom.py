"""Bloom filter of a key column: a bit set of bounded size that travels with the tasks.

It only thins out rows before a join: false positives (more of them, once the keys exceed
what ``max_bits`` can tell apart) vanish in the join.  The set is built by a grouped
``bit_or``, so what reaches the driver is the set itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
PER_KEY = 12            # bits per key
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27     # at most 16 MB


class Bloom:
    """Two bits per 64-bit key."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = U64(64 * len(words) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be in the set."""
        first = np.flatnonzero(self._bit(h & self.mask))
        return first[self._bit((h[first] >> U64(32)) & self.mask).astype(bool)]

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)


def build(keys: DataFrame, column: str, max_bits: int = MAX_BITS,
          per_key: int = PER_KEY) -> Bloom:
    """Filter of a column of 64-bit hashes."""
    n, bits = keys.count(), MIN_BITS
    while bits < min(per_key * n, max_bits):
        bits *= 2
    at = F.explode(F.array(F.col(column).bitwiseAND(bits - 1),
                           F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1)))
    got = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=U64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return Bloom(words)
