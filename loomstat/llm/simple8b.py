"""Simple-8b word-aligned coding of token ids (operator 2).

A 64-bit word holds a selector in its top four bits and as many ids as fit, all
of one width, in the other sixty. Selector 0 is an escape: the next word is one
id of up to 64 bits. Ids are coded in blocks of ``BLOCK``; a block begins with
a new word, and a page keeps the word offset of each of its blocks, so that a
range of ids is decoded from its blocks alone and all words of a page are
decoded together in numpy.

The files are Parquet files of pages, written by Spark. A page holds whole
documents: their ids and lengths, the words, the block offsets, its shard
and the number of ids before it in the shard. Shards are ranges of document
ids in ascending order.

Defined results: a null text counts as empty and has only the end id; null ids
come first; equal ids lie next to each other, in order of a text hash; an
empty table writes no page; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.llm.common import parallelism, steps
from loomstat.llm.encoding import TOKENIZER, checksum, process_encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ids per word and their width by selector (fixed values of the coding; selector 0 escapes).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
LIMITS = np.uint64(1) << WIDTHS[1:].astype(np.uint64)
#: The narrowest width of small numbers.
CODES = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8)
BLOCK = 1024
PAGE_SCHEMA = ("shard int, page int, before long, n_ids long, doc_ids array<long>, lengths array<long>, "
               "words binary, offsets array<int>")


def windows(values: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of ``COUNTS``, the largest of so many values from every place on (0 past the end)."""
    out, n = {1: values}, 1
    for count in sorted(set(COUNTS.tolist()) - {1}):
        by = count - n  # the window of n values, and the same one further on
        held, out[count] = out[n], out[n].copy()
        if by > n:
            raise ValueError("counts may at most double")
        np.maximum(out[count][:-by], held[by:], out=out[count][:-by])
        n = count
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of every block."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # the narrowest width of each id, as its place in WIDTHS[1:]; blocks lie apart, so no word reaches into the next
    rows, most = -(-n // block), int(COUNTS.max())
    fits = np.zeros((rows, block + most), np.int8)
    codes = np.zeros(rows * block, np.int8)
    codes[:n] = CODES[np.minimum(ids, len(CODES) - 1).astype(np.int64)]
    large = np.flatnonzero(ids >= len(CODES))
    codes[large] = np.searchsorted(LIMITS, ids[large], side="right")
    fits[:, :block] = codes.reshape(rows, block)
    widest = windows(fits.ravel())
    chosen = np.full(fits.size, len(COUNTS), np.int8)  # the first selector that fits takes most ids
    for s in range(1, len(COUNTS)):
        np.minimum(chosen, np.where(widest[int(COUNTS[s])] < s, np.int8(s), np.int8(len(COUNTS))), out=chosen)
    chosen = chosen.reshape(rows, -1)[:, :block].ravel()[:n] % len(COUNTS)  # none fits: an escape
    step = COUNTS[chosen].astype(np.int32)
    place = np.arange(n, dtype=np.int32)
    step = np.minimum(step, np.minimum((place // block + 1) * block, n) - place)
    heads, at = [], np.arange(0, n, block)
    while len(at):  # all blocks advance together, a word a turn
        heads.append(at)
        after = at + step[at]
        at = after[(after < n) & (after % block != 0)]
    starts = np.sort(np.concatenate(heads))
    sel = chosen[starts]
    slot = np.arange(len(starts)) + np.r_[0, np.cumsum(sel == 0)[:-1]]
    words = np.zeros(len(starts) + int((sel == 0).sum()), np.uint64)
    padded = np.r_[ids, np.zeros(most, np.uint64)]
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            begin, held = starts[mine], step[starts[mine]]
            packed = np.full(len(mine), s << 60, np.uint64)
            for k in range(int(held.max())):
                packed |= np.where(k < held, padded[begin + k], np.uint64(0)) << np.uint64(k * int(WIDTHS[s]))
            words[slot[mine]] = packed
    escaped = np.flatnonzero(sel == 0)
    words[slot[escaped] + 1] = ids[starts[escaped]]
    return words, slot[starts % block == 0]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of all blocks."""
    words = np.asarray(words, np.uint64)
    if n == 0:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    coded = np.ones(len(words), bool)
    # a raw word follows each escape; raw words may look like escapes, so they are walked one by one, and they are rare
    zero = np.flatnonzero(sel == 0)
    if len(zero):
        last = -2
        for z in zero.tolist():
            if z != last + 1:
                last = z
                coded[z + 1] = False
    at = np.flatnonzero(coded)
    sel = sel[at]
    counts = COUNTS[sel]
    of_block = np.searchsorted(offsets, at, side="right") - 1
    ends = np.cumsum(counts)
    base = np.r_[0, ends][np.searchsorted(at, offsets)]
    begin = of_block * block + (ends - counts - base[of_block])
    stop = np.minimum((of_block + 1) * block, n)
    out = np.empty(n, np.uint64)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            k = np.arange(COUNTS[s])
            where = begin[mine][:, None] + k
            values = (words[at[mine]][:, None] >> (k * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
            inside = where < stop[mine][:, None]
            out[where[inside]] = values[inside]
    raw = np.flatnonzero(sel == 0)
    out[begin[raw]] = words[at[raw] + 1]
    return out


def decode_range(words: np.ndarray, offsets: np.ndarray, n: int, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """Ids ``start`` to ``stop`` from the blocks that hold them."""
    first, last = start // block, -(-stop // block)
    to = offsets[last] if last < len(offsets) else len(words)
    part = decode(words[offsets[first] : to], offsets[first:last] - offsets[first], min(n, last * block) - first * block, block)
    return part[start - first * block : stop - first * block]


def write(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text",
          tokenizer: str = TOKENIZER, tokenizer_path: str | None = None, shards: int | None = None) -> None:
    """Encode every text, append ``end`` and write the page files in ascending id order."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, page, before = process_encoder(tokenizer, tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in steps(batch, "text"):
                lengths, ids = encoder.encode(part.column("text"), end)
                words, offsets = encode(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id")),
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.array(lengths)),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(offsets)], pa.int32()), pa.array(offsets.astype(np.int32)))],
                    ["shard", "page", "before", "n_ids", "doc_ids", "lengths", "words", "offsets"])
                page, before = page + 1, before + len(ids)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shards or parallelism(df.sparkSession), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    ordered.mapInArrow(pages, PAGE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of the documents in the files at ``path``."""
    files = spark.read.schema(PAGE_SCHEMA).parquet(path)
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(bases), "shard").select(
        (F.col("base") + F.col("before")).alias("base"), "n_ids", "doc_ids", "lengths", "words", "offsets")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, n = (batch.column(c)[row].as_py() for c in ("base", "n_ids"))
                lengths, offsets = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lengths", "offsets"))
                ids = decode(np.frombuffer(batch.column("words")[row].as_py(), "<u8"), offsets, n).astype("<u4")
                stops = np.cumsum(lengths)
                sums = [checksum(ids[b - k : b]) for b, k in zip(stops.tolist(), lengths.tolist())]
                columns = [batch.column("doc_ids")[row].values, pa.array(base + stops - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
