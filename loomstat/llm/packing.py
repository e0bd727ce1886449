"""Best-fit packing of documents into token sequences (operator 9).

Documents are encoded where they lie; only pieces' lengths and checksums move.
Pieces are dealt evenly over tasks of about ``PIECES`` each and packed there by
best-fit decreasing: a segment tree over the remaining capacities finds the
tightest open sequence in logarithmic time. Each task leaves at most a few
sequences part empty, a vanishing share of what it packs.

Only documents over the capacity are cut, into full pieces and a rest. Defined
results: a null text counts as empty and has only the end id; rows of equal
ids are documents of their own; an empty table gives no rows; other columns are
ignored. Sequence numbers are unique, not consecutive, and the same in a rerun.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import by_step, stored
from loomstat.llm.encoding import TOKENIZER, checksum, process_encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 4096
#: Bytes of remembered words of a worker, and characters encoded at a time: packing follows other stages in the same executors.
REMEMBERED, STEP = 24 << 20, 1_000_000
#: Pieces packed by one task.
PIECES = 200_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Capacities:
    """A segment tree over remaining capacities: which are open, smallest first."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def change(self, left: int, by: int) -> None:
        i = left + self.leaves
        while i:
            self.open[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least ``need``."""
        i, tree = need + self.leaves, self.open
        if tree[i]:
            return need
        while i > 1:  # climb until a right-hand neighbour holds something, then go down its left edge
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` are in descending order."""
    tree, bins_by_left = Capacities(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for k, need in enumerate(lengths.tolist()):
        left = tree.tightest(need)
        if left is None:
            left, where = capacity, used
            used += 1
        else:
            where = bins_by_left[left].pop()
            tree.change(left, -1)
        bins[k], offsets[k] = where, capacity - left
        if left > need:
            bins_by_left[left - need].append(where)
            tree.change(left - need, 1)
    return bins, offsets


def pieces(df: DataFrame, end: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
           tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ids = process_encoder(tokenizer, tokenizer_path, REMEMBERED).encode(part.column("text"), end)
        many = -(-lengths // capacity)
        owner = np.repeat(np.arange(len(lengths)), many)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(capacity, lengths[owner] - number * capacity)
        stops = np.cumsum(size)
        sums = [checksum(ids[b - k : b]) for b, k in zip(stops.tolist(), size.tolist())]
        return pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(size), pa.array(sums, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = by_step(one, limit=STEP)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack(df: DataFrame, end: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         tokenizer_path: str | None = None, capacity: int = CAPACITY, task_pieces: int = PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    found = stored(pieces(df, end, id_col, text_col, tokenizer, tokenizer_path, capacity)
                   .withColumn("row", F.monotonically_increasing_id()), "pieces")
    tasks = max(1, -(-found.count() // task_pieces))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=schema)  # of about `task_pieces` rows
        if table.num_rows == 0:
            return
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity)
        first = TaskContext.get().partitionId() << 40
        whole = table.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))
        yield from whole.to_batches(max_chunksize=100_000)

    dealt = found.repartition(tasks, F.xxhash64("row")).sortWithinPartitions(F.desc("length"), "row").drop("row")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return dealt.mapInArrow(packed, PIECE_SCHEMA + ", sequence_id long, offset long")
