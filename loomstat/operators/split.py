"""Train/test split, sample and folds decided by a hash of the row key.

A seeded shuffle depends on how rows are partitioned; a keyed hash does not,
needs no shuffle, and gives the same rows after a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.exprs import digest_word, hex_cut, key_digest, literal_array, q
from loomstat.session import cut_lineage


def split_column(key: Column, ratio: float, seed: int) -> Column:
    in_test = digest_word(key_digest(key, seed), 0) < hex_cut(ratio)
    return F.when(in_test, F.lit("test")).otherwise(F.lit("train"))


def fold_column(key: Column, k: int, seed: int) -> Column:
    """From another word of the same digest, so folds are independent of the
    split and the hash is computed once per row."""
    word = digest_word(key_digest(key, seed), 1)
    return sum((F.when(word >= hex_cut(i / k), F.lit(1)).otherwise(F.lit(0)) for i in range(1, k)), F.lit(0)).cast("int")


def hash_split(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 2022, output: str = "split") -> DataFrame:
    """Mark about ``ratio`` of the keys ``test``, the others ``train``."""
    return df.withColumn(output, split_column(q(key), ratio, seed))


#: Hex digits by which a bin of digests is divided in one counting pass, and rows of a bin that are ordered at once.
BIN_DIGITS, DIRECT_ROWS = 4, 10_000


def exact_split(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 2022, output: str = "split",
                tie_break: Sequence[str] = (), direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Exactly ``ceil(ratio * n)`` test rows: the first in hash order.

    The last test row is found by its rank: rows are counted by the leading
    digits of their hash, only the bin that holds the rank is divided again,
    and a small bin is ordered. Then the split is a comparison with that row:
    no row moves. Of rows equal to it in hash, key and ``tie_break``, as many
    as are missing become test rows (only these are stored and numbered).
    """
    digest = key_digest(q(key), seed)
    counted = df.groupBy(F.substring(digest, 1, BIN_DIGITS).alias("bin")).agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in counted)
    # 0.2 * n in floating point can land just above an integer; hence the trim
    rank = math.ceil(round(ratio * n, 9))
    if rank <= 0 or rank >= n:
        return df.withColumn(output, F.lit("test" if n and rank >= n else "train"))
    low, digits = "", BIN_DIGITS
    while True:  # a null key has a null digest, which comes first
        for r in sorted(counted, key=lambda r: (r["bin"] is not None, r["bin"])):
            if rank <= r["n"]:
                break
            rank -= r["n"]
        low, held = r["bin"], r["n"]
        inside = df.where(digest.isNull() if low is None else F.substring(digest, 1, digits) == low)
        if held <= direct_rows or low is None or digits >= 32:
            break
        digits += BIN_DIGITS
        counted = inside.groupBy(F.substring(digest, 1, digits).alias("bin")).agg(F.count("*").alias("n")).collect()
    order = [digest, q(key).cast("string"), *[q(c) for c in tie_break]]
    names = [f"_o{i}" for i in range(len(order))]
    # distinct values with their counts: a hot key is one row of these
    ranked = inside.groupBy(*[c.alias(x) for c, x in zip(order, names)]).agg(F.count("*").alias("_n"))
    for edge in ranked.orderBy(*names).toLocalIterator():
        if rank <= edge["_n"]:
            break
        rank -= edge["_n"]
    bound = F.struct(*[F.lit(edge[x]).cast(ranked.schema[x].dataType).alias(x) for x in names])
    row = F.struct(*[c.alias(x) for c, x in zip(order, names)])
    mark = lambda test: F.when(test, F.lit("test")).otherwise(F.lit("train"))
    if rank == edge["_n"]:
        return df.withColumn(output, mark(row <= bound))
    tied = cut_lineage(df.where(row == bound).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33)
    sizes, begins, place = tied.groupBy(part.alias("part")).count().orderBy("part").collect(), {}, 0
    for r in sizes:
        begins[r["part"]] = place
        place += r["count"]
    starts = literal_array([begins.get(k, 0) for k in range(max(begins) + 1)], "array<bigint>")
    taken = F.get(starts, part.cast("int")) + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) < rank
    return df.where(row != bound).withColumn(output, mark(row < bound)).unionByName(tied.withColumn(output, mark(taken)).drop("_slot"))


def hash_sample(df: DataFrame, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the smallest key hashes, found by a
    per-partition top-n rather than a full sort."""
    digest = key_digest(q(key), seed)
    return df.withColumn("_digest", digest).orderBy("_digest", q(key)).limit(n).drop("_digest")


def assign_fold(df: DataFrame, key: str, k: int = 5, seed: int = 2022, output: str = "fold") -> DataFrame:
    """Fold number ``0..k-1``."""
    return df.withColumn(output, fold_column(q(key), k, seed))
