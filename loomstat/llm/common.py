"""What the training-data operators share: tables, storage, folds, word helpers.

Functions run inside tasks are shipped by value, so executors need NumPy,
pandas, Arrow and the named libraries but not this package.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of text that one kernel step works on at a time.
STEP_CHARS = 2_000_000
#: Bytes of a batch between Spark and Python while an intermediate table is written.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back:
    later passes start from the files, also after a lost executor, and the
    planner knows their real size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))  # rows that carry long arrays come to Python a few at a time
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(fold_of(id_col, folds) == 0, F.lit(False))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back: a worker process outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column``
    (one longer text makes a part of its own): memory stays bounded however
    long the texts of a batch are."""
    if batch.num_rows == 0:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
        # a copy: string kernels of some Arrow versions misread slices that begin inside a buffer
        yield batch.take(pa.array(np.arange(a, b)))
    release()


def by_step(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = STEP_CHARS) -> Callable:
    """A ``mapInArrow`` function that applies ``fn`` to bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column, limit):
                yield fn(part)

    return run


def strings(values: pa.Array) -> list[str]:
    """An array's strings as a list, much faster than one scalar after the other."""
    return values.to_numpy(zero_copy_only=False).tolist()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split on ASCII white space (0x20, 0x09-0x0D).

    Returns the number of words per text, an index per word into the distinct
    words, and the distinct words. Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # an empty text splits into one empty word
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[filled]
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_text(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum ``values`` (one row per word) over the words of each text."""
    bounds = np.r_[0, np.cumsum(counts)]
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def hot_join(df: DataFrame, groups: DataFrame, key: str, size_col: str, rows: int, least: int = 1024) -> DataFrame:
    """Inner join of ``df`` with one row per group on ``key``.

    Groups of more than ``rows / least`` members number ``least`` at most, so
    they are broadcast; the others cannot make a hot task and are shuffled.
    """
    g = groups.withColumnRenamed(key, "__group")
    limit = max(least, rows // least)
    hot, cold = g.where(F.col(size_col) > limit), g.where(F.col(size_col) <= limit)
    on = F.col(key) == F.col("__group")
    first = df.join(F.broadcast(hot), on).drop("__group")
    rest = df.join(F.broadcast(hot.select("__group")), on, "left_anti").join(cold, on).drop("__group")
    return first.unionByName(rest)
