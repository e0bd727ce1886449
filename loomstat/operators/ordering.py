"""Order-dependent operators that never put the whole series in one task.

A global ``orderBy`` window runs on a single partition. Instead the order is cut
into cells before any row moves, and one counting pass gives the exact number of
rows in each cell, hence the place in the total order at which it begins. Cells
are equal widths of the first key where it is a number or time spread evenly
enough, which costs one division a row; elsewhere their bounds come from a
sample of the sort keys. Consecutive cells make chunks of about equal length,
and the cells that end a chunk also travel to the next one, so a trailing frame
finds the rows before it. Rows are therefore exchanged once, by chunk, and
numbered there; nothing is stored. One repeated timestamp cannot make a hot
task, as sampled bounds are taken over all keys of the order together.

A table that several operators go through in one order is better sorted once
(``sorted_rows``) and stored; its places (``placed``) are an evenly spread key.

``order_by`` must be a total order: rows equal in all its columns lie in one cell,
and their order is arbitrary. Nulls come first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.exprs import literal_array, q

CHUNK_ROWS = 100_000
#: Cells a chunk consists of, and the most there are: their bounds are a literal of the plan. Beyond, chunks grow.
CELLS_PER_CHUNK, MAX_CELLS = 8, 1 << 14
#: Sampled keys per cell.
SAMPLED = 10
#: Equal widths serve while no cell holds more than this many times its share of the rows.
UNEVEN = 4
#: Rows of a partition of ``sorted_rows``, and the most partitions there are.
SORTED_ROWS, MAX_SORTED = 200_000, 4096
POSITION = "_position"
PLACE = "_place"
_SLOT = "_slot"
_CHUNK = "_chunk"
_REAL = "_real"


def _plain_key(c: Column, kind: T.DataType) -> tuple[Column, str] | None:
    """A sort key as a number or text that keeps its order (different keys may become equal)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return c.cast("bigint"), "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return c.cast("double"), "double"
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint"), "bigint"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c), "bigint"
    if isinstance(kind, (T.StringType, T.TimestampNTZType)):
        return c.cast("string"), "string"
    return None


@dataclass
class Cuts:
    """Where the order is cut: ``bounds`` are the first keys of cells 1, 2, ..., or ``widths`` holds the first
    key's column, range and number of equal cells, nulls being cell 0; ``sizes`` are their exact row counts."""

    key: Column
    kind: str
    bounds: list[tuple]
    sizes: list[int]
    widths: tuple[Column, float, float, int] | None = None

    def cell(self) -> Column:
        """Cell of a row: its share of the range, or the number of bounds not above its key, by halving steps."""
        if self.widths is not None:
            first, low, high, cells = self.widths
            # infinite readings lie in the end cells, NaN in the last one
            share = (F.least(F.greatest(first, F.lit(low)), F.lit(high)) - low) / (high - low)
            return F.when(first.isNull(), 0).otherwise(1 + F.least(F.floor(share * cells), F.lit(cells - 1))).cast("int")
        if not self.bounds:
            return F.lit(0)
        bounds = literal_array([{f"k{i}": v for i, v in enumerate(b)} for b in self.bounds], self.kind)
        steps = [1 << k for k in range(len(self.bounds).bit_length() - 1, -1, -1)]

        def move(at: Column, step: Column) -> Column:
            to = at + step
            return F.when((to <= len(self.bounds)) & (F.get(bounds, to - 1) <= self.key), to).otherwise(at)

        return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), move)


def cut_order(df: DataFrame, order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> Cuts:
    """Cells of the total order, and their exact sizes."""
    plain = []
    for c in order_by:
        key = _plain_key(q(c), df.select(q(c)).schema[0].dataType)
        if key is None:
            break  # a prefix of the keys still keeps the order
        plain.append(key)
    first = plain[0][0].cast("double") if plain and plain[0][1] != "string" else F.lit(None).cast("double")
    there = F.when(F.abs(first) < math.inf, first)
    n, low, high = df.agg(F.count("*"), F.min(there), F.max(there)).first()
    cuts = Cuts(F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(plain)]) if plain else F.lit(0),
                "array<struct<" + ", ".join(f"k{i}: {t}" for i, (_, t) in enumerate(plain)) + ">>", [], [n])
    if n <= chunk_rows or not plain:
        return cuts
    cells = min(MAX_CELLS, CELLS_PER_CHUNK * math.ceil(n / chunk_rows))
    if low is not None and 0 < high - low < math.inf:
        even = Cuts(cuts.key, cuts.kind, [], [], (first, low, high, cells))
        even.sizes = _cell_sizes(df, even, cells + 1)
        if max(even.sizes) <= UNEVEN * n / cells:
            return even
    keys = df.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(plain)])
    sample = keys if n <= SAMPLED * cells else keys.sample(SAMPLED * cells / n, seed=7)
    fine = [tuple(r) for r in sample.collect() if all(not isinstance(v, float) or math.isfinite(v) for v in r)]
    fine = sorted(set(fine), key=lambda r: [(v is not None, v) for v in r])
    cuts.bounds = fine[len(fine) // cells :: max(1, len(fine) // cells)] if len(fine) > cells else fine
    cuts.sizes = _cell_sizes(df, cuts, len(cuts.bounds) + 1)
    return cuts


def _cell_sizes(df: DataFrame, cuts: Cuts, cells: int) -> list[int]:
    found = {r["cell"]: r["n"] for r in df.groupBy(cuts.cell().alias("cell")).agg(F.count("*").alias("n")).collect()}
    return [found.get(k, 0) for k in range(cells)]


def chunked(df: DataFrame, order_by: Sequence[str], before: int = 0, chunk_rows: int = CHUNK_ROWS, position: str = POSITION,
            places: bool = False) -> DataFrame:
    """Rows dealt to chunks of consecutive rows, each preceded by at least
    ``before`` rows where there are so many. ``_real`` is false on these
    copies; ``position`` is the 0-based place in the order, numbered in each
    chunk unless ``places`` says that ``order_by`` is the place itself."""
    cuts = cut_order(df, order_by, max(chunk_rows, before, 1))
    least = max(chunk_rows, before, sum(cuts.sizes) * CELLS_PER_CHUNK // MAX_CELLS, 1)
    firsts, begins, place, held = [0], [0], 0, 0  # first cell and first place of every chunk
    for k, size in enumerate(cuts.sizes):
        if held >= least:
            firsts.append(k)
            begins.append(place)
            held = 0
        place, held = place + size, held + size
    homes: list[list[dict]] = [[] for _ in cuts.sizes]
    starts = []  # first place of every chunk with its copies
    for c, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(cuts.sizes)])):
        low, copied = a, 0
        while low > 0 and copied < before:
            low -= 1
            copied += cuts.sizes[low]
        starts.append(begins[c] - copied)
        for k in range(low, b):
            homes[k].append({"c": c, "own": k >= a})
    if len(firsts) == 1:
        dealt = df.withColumns({_CHUNK: F.lit(0), _REAL: F.lit(True)})
    else:
        to = literal_array(homes, "array<array<struct<c: int, own: boolean>>>")
        dealt = df.select("*", F.inline(F.get(to, cuts.cell())).alias(_CHUNK, _REAL))
    if places:
        return dealt.withColumn(position, q(order_by[0]).cast("bigint"))
    number = F.row_number().over(Window.partitionBy(_CHUNK).orderBy(*[q(c) for c in order_by])).cast("bigint")
    return dealt.withColumn(position, number - 1 + F.get(literal_array(starts, "array<bigint>"), F.col(_CHUNK)))


def sorted_rows(df: DataFrame, order_by: Sequence[str], rows: int = SORTED_ROWS) -> DataFrame:
    """Rows in the total order ``order_by``, each with a slot that becomes its
    place once they are stored (``placed``): one exchange by ranges of all keys
    of the order, sorted where the rows arrive."""
    parts = min(MAX_SORTED, max(1, math.ceil(df.count() / rows)))
    keys = [q(c) for c in order_by]
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(_SLOT, F.monotonically_increasing_id())


def placed(stored: DataFrame, output: str = PLACE) -> DataFrame:
    """The 0-based place of each row of ``sorted_rows``, read back from where it
    was stored (a slot is only meaningful there)."""
    part = F.shiftright(_SLOT, 33).cast("int")
    sizes = {r["part"]: r["n"] for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    begins, place = [], 0
    for k in range(max(sizes, default=0) + 1):
        begins.append(place)
        place += sizes.get(k, 0)
    at = F.get(literal_array(begins, "array<bigint>"), part) + F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn(output, at).drop(_SLOT)


def numbered(df: DataFrame, order_by: Sequence[str], position: str = POSITION, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the 0-based place of each row in the total order ``order_by``."""
    return chunked(df, order_by, 0, chunk_rows, position).drop(_CHUNK, _REAL)


def over_order(
    df: DataFrame,
    order_by: Sequence[str],
    add: Callable[[DataFrame], DataFrame],
    before: int,
    by: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    places: bool = False,
) -> DataFrame:
    """Apply ``add``, which may use windows within a chunk (and ``by``) that look
    back at most ``before`` rows; drops the helper columns and copied rows."""
    out = chunked(df, [*by, *order_by], before, chunk_rows, places=places)
    return add(out).where(_REAL).drop(_CHUNK, _REAL, POSITION)


def rolling_mean(
    df: DataFrame,
    col: str,
    order_by: Sequence[str],
    rows: int = 720,
    min_periods: int = 60,
    by: Sequence[str] = (),
    output: str = "rolling_mean",
    count_output: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
    places: bool = False,
) -> DataFrame:
    """Trailing mean over ``rows`` rows, the current one included; null until
    ``min_periods`` finite readings are in the frame. ``count_output`` names a
    column for the number of finite readings. ``places`` says that ``order_by``
    is one column with the 0-based places of the rows, none of them absent.

    The order is cut into blocks as long as the frame, so a frame is the end of
    one block and the beginning of the next: two sums that a block shares among
    its rows, added once a row whatever the frame's length. Nothing is ever
    subtracted, so a huge reading touches only the frames that hold it, and the
    blocks lie at fixed places, so the result doesn't depend on ``chunk_rows``.
    """
    value = q(col).cast("double")
    value = F.when(F.abs(value) < float("inf"), value)  # false for NaN, too
    # blocks follow positions, so these windows share one sort with those inside a block
    series = Window.partitionBy(_CHUNK, *[q(c) for c in by]).orderBy("_block", POSITION)
    block = F.floor(F.col(POSITION) / rows)
    in_block = Window.partitionBy(_CHUNK, *[q(c) for c in by], "_block").orderBy(POSITION)
    head = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # summed from the block's end: a frame to the end of its partition would be summed anew for every row
    back = Window.partitionBy(_CHUNK, *[q(c) for c in by], "_block").orderBy(F.desc(POSITION))
    tail = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def frame(name: str) -> Column:
        """The block's rows so far, and those of the block before that the frame still holds: from the
        frame's first row on, or from the first row of a series that begins in that block."""
        begins_before = F.first("_block").over(so_far) == F.col("_block") - 1
        earlier = F.coalesce(
            F.lag(f"_tail_{name}", rows - 1).over(series), F.when(begins_before, F.first(f"_tail_{name}").over(so_far)))
        whole = F.col(POSITION) % rows == rows - 1  # the frame is this very block
        return F.col(f"_head_{name}") + F.when(whole, 0).otherwise(F.coalesce(earlier, F.lit(0)))

    def add(chunks: DataFrame) -> DataFrame:
        def sums(name: str, window: Window) -> dict[str, Column]:
            return {f"_{name}_sum": F.coalesce(F.sum(value).over(window), F.lit(0.0)), f"_{name}_n": F.count(value).over(window)}

        parts = chunks.withColumn("_block", block).withColumns(sums("tail", tail)).withColumns(sums("head", head))
        framed = parts.withColumns({"_frame_sum": frame("sum"), "_frame_n": frame("n")})
        mean = F.when(F.col("_frame_n") >= max(min_periods, 1), F.col("_frame_sum") / F.col("_frame_n"))
        out = framed.withColumn(output, mean)
        if count_output:
            out = out.withColumn(count_output, F.col("_frame_n"))
        return out.drop("_block", "_head_sum", "_head_n", "_tail_sum", "_tail_n", "_frame_sum", "_frame_n")

    return over_order(df, order_by, add, rows - 1, by, chunk_rows, places)


def lagged(
    df: DataFrame,
    col: str,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    output: str = "lagged",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Previous row's value in the order."""
    previous = F.lag(q(col), 1).over(Window.partitionBy(_CHUNK, *[q(c) for c in by]).orderBy(*[q(c) for c in order_by]))
    return over_order(df, order_by, lambda chunks: chunks.withColumn(output, previous), 1, by, chunk_rows)


def ntile(df: DataFrame, order_by: Sequence[str], buckets: int, output: str = "tile") -> DataFrame:
    """SQL ``ntile`` over the total order, from the row number and the count:
    the first ``n % buckets`` tiles get one row more.

    A cell of the order that lies in one tile gives it to all of its rows, which
    stay where they are; only rows of cells in which a tile ends are numbered."""
    cuts = cut_order(df, order_by)
    small, extra = divmod(sum(cuts.sizes), buckets)
    edge = extra * (small + 1)

    def tile_at(pos: int) -> int:
        return pos // (small + 1) + 1 if pos < edge else extra + (pos - edge) // small + 1

    begins, tiles, place = [], [], 0
    for size in cuts.sizes:
        ends = {tile_at(place), tile_at(place + size - 1)} if size else set()
        begins.append(place)
        tiles.append(ends.pop() if len(ends) == 1 else None)
        place += size
    known = F.get(literal_array(tiles, "array<int>"), cuts.cell())
    number = F.row_number().over(Window.partitionBy(_CHUNK).orderBy(*[q(c) for c in order_by]))
    pos = F.get(literal_array(begins, "array<bigint>"), F.col(_CHUNK)) + number - 1
    tile = F.floor(pos / (small + 1)) + 1
    if small:
        tile = F.when(pos < edge, tile).otherwise(F.lit(extra) + F.floor((pos - edge) / small) + 1)
    cut = df.where(known.isNull()).withColumn(_CHUNK, cuts.cell()).withColumn(output, tile.cast("int")).drop(_CHUNK)
    return cut if not any(tiles) else df.where(known.isNotNull()).withColumn(output, known).unionByName(cut)
