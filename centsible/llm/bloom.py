"""A blocked Bloom filter, filled on the executors and asked with NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of 32 bits: one block of the filter
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20
#: The multipliers of Parquet's split-block filter; each picks one bit of a word.
BIT_PICKERS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(blocks))


def _bit(hashed: Column, word: int) -> Column:
    low = hashed.bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftrightunsigned(low * F.lit(BIT_PICKERS[word]), 26).bitwiseAND(F.lit(31)).cast("int")


class BloomFilter:
    """Blocks of 256 bits; a key sets one bit in each word of one block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @classmethod
    def build(cls, hashes: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> BloomFilter:
        """Filter of a column of 64-bit hashes of any length. Its size follows the number of keys up to
        ``max_bytes``; beyond that it only lets more false positives through to the join."""
        count = hashes.count()
        blocks = max(1, min(max_bytes // (4 * WORDS), -(-count * BITS_PER_KEY // (32 * WORDS))))
        hashed = hashes.toDF("h")
        words = [
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"), w))).alias(f"w{w}")
            for w in range(WORDS)
        ]
        filled = np.zeros((blocks, WORDS), np.uint32)
        # one job; at most max_bytes of blocks and their numbers, whatever the length of the list
        rows = hashed.groupBy(_block(F.col("h"), blocks).cast("int").alias("block")).agg(*words)
        found = rows.select("block", *[F.col(f"w{w}").cast("long").alias(f"w{w}") for w in range(WORDS)]).toArrow()
        block = found["block"].to_numpy()
        for w in range(WORDS):
            filled[block, w] = found[f"w{w}"].to_numpy().astype(np.uint32)
        return cls(filled)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        block = self.blocks[(h >> np.uint64(32)) % np.uint64(len(self.blocks))]
        low = h & np.uint64(0x7FFFFFFF)
        found = np.ones(len(h), bool)
        for word, picker in enumerate(BIT_PICKERS):
            bit = (low * np.uint64(picker) >> np.uint64(26)) & np.uint64(31)
            found &= (block[:, word] >> bit.astype(np.uint32)) & np.uint32(1) == 1
        return found
