"""A blocked Bloom filter: one 64-byte block and eight bits a key, of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 64-bit words a block; a key sets one bit in each


def blocks_for(keys: int, bits_per_key: int = 16, max_blocks: int = 1 << 18) -> int:
    """Blocks for so many keys, 16 MB at most: beyond, more keys pass that should not."""
    return int(min(max_blocks, max(1, keys * bits_per_key // (64 * WORDS) + 1)))


def build(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter of a table of 64-bit keys (column key), as one partial aggregation a block; ``blocks`` bounds what the driver gets."""
    bit = lambda k: F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.col("bits"), 6 * k), F.lit(64)).cast("int")
    )
    got = (
        keys.select(F.pmod(F.col("key"), F.lit(blocks)).cast("long").alias("block"), _bits(F.col("key")).alias("bits"))
        .groupBy("block").agg(*[F.bit_or(bit(k)).alias(f"w{k}") for k in range(WORDS)]).toPandas()
    )
    table = np.zeros((blocks, WORDS), dtype=np.uint64)
    if len(got):
        table[got["block"].to_numpy()] = got[[f"w{k}" for k in range(WORDS)]].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def _bits(key: Column) -> Column:
    """48 bits of the key that the number of its block, from the low ones, tells little of."""
    return F.shiftrightunsigned(key, 16)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (unsigned) may be in the filter."""
    signed = keys.view(np.int64)
    block, bits = np.mod(signed, np.int64(len(table))), keys >> np.uint64(16)
    hit = np.ones(len(keys), dtype=bool)
    for k in range(WORDS):
        bit = np.uint64(1) << ((bits >> np.uint64(6 * k)) & np.uint64(63))
        hit &= (table[block, k] & bit) != 0
    return hit
