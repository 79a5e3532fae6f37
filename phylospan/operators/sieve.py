"""A sieve of an index's minimizers: two bits a key in one bit array, built by an aggregation and broadcast.

Most tokens of a read are in no index.  Where the index is joined, the sieve tells most of these apart while
the read is scanned, so that only the others are shuffled.  It is never wrong about a minimizer that the index has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.functions.bits import fmix64, murmur64

#: Bits a key, and bits in all at most (64 MB); a larger index fills them more and lets more tokens through.
BITS_A_KEY, MOST_BITS = 16, 1 << 29


class Sieve:
    def __init__(self, size: int, words: np.ndarray):
        self.size, self.words = size, words

    def maybe(self, m: np.ndarray) -> np.ndarray:
        """Whether minimizers may be in the index."""
        out = np.ones(len(m), bool)
        h = fmix64(m)
        for shift in (64 - self.size, 64 - 2 * self.size):
            at = (h >> np.uint64(max(0, shift))) & np.uint64((1 << self.size) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def sieve_of(index: DataFrame, rows: int) -> Sieve:
    """The sieve of ``index(minimizer, ..)`` of so many rows: words are combined in every task before they move."""
    size = min(MOST_BITS, max(1 << 10, BITS_A_KEY * rows)).bit_length() - 1
    h = murmur64(F.col("minimizer"))
    places = F.array(*[F.shiftrightunsigned(h, max(0, shift)).bitwiseAND(F.lit((1 << size) - 1)) for shift in (64 - size, 64 - 2 * size)])
    bits = index.select(F.explode(places).alias("at"))
    words = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Sieve(size, out)
