"""Blocked Bloom filters as DataFrames, built and tested with built-in functions only.

A filter is a table ``(block long, bits long)``: a key sets three bits of one
64-bit word. Testing it is a broadcast join on ``block``, which moves no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys a filter may hold to be broadcast (a quarter as many words of 16 bytes).
MAX_KEYS = 8_000_000
KEYS_PER_BLOCK = 4


def _shift(h: Column, n: int) -> Column:
    return F.shiftrightunsigned(h, n)


def block_of(key: Column, blocks: int) -> Column:
    """Word of a key; ``blocks`` is a power of two."""
    return _shift(F.xxhash64(key), 18).bitwiseAND(F.lit(blocks - 1).cast("long"))


def mask_of(key: Column) -> Column:
    """The three bits of a key."""
    h = F.xxhash64(key)

    def bit(n: int) -> Column:
        place = _shift(h, n).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def blocks_for(keys: int) -> int:
    need = max(1, -(-keys // KEYS_PER_BLOCK))
    return 1 << (need - 1).bit_length()


def build(keys: DataFrame, key: str, n: int) -> DataFrame:
    """The filter that holds ``key`` of every row; ``n`` is the row count."""
    blocks = blocks_for(n)
    return (
        keys.select(block_of(F.col(key), blocks).alias("block"), mask_of(F.col(key)).alias("mask"))
        .groupBy("block").agg(F.bit_or("mask").alias("bits"))
    )


def split(df: DataFrame, key: Column, keys: DataFrame, key_name: str, n: int, name: str, max_keys: int = MAX_KEYS) -> DataFrame:
    """Add the boolean ``name``: false only where ``key`` is certainly not among ``keys``.

    Up to ``max_keys`` keys the filter is broadcast and no row moves; above,
    the keys themselves are joined, which is exact and has no size limit.
    """
    if n == 0:
        return df.withColumn(name, F.lit(False))
    if n <= max_keys:
        held = F.broadcast(build(keys, key_name, n).withColumnsRenamed({"block": "__block", "bits": "__bits"}))
        return (
            df.join(held, block_of(key, blocks_for(n)) == F.col("__block"), "left")
            .withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(mask_of(key)) == mask_of(key), F.lit(False)))
            .drop("__block", "__bits")
        )
    held = keys.select(F.col(key_name).alias("__key")).distinct()
    return df.join(held, key == F.col("__key"), "left").withColumn(name, F.col("__key").isNotNull()).drop("__key")
