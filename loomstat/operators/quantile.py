"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a column in one aggregation
buffer, which a continuous sensor with 1e12 readings does not survive. Here
each pass counts the rows per value bin (a map-side combined aggregate), keeps
only the bins holding a wanted rank, and splits those again. When a bin holds
few enough rows, their order is taken exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.exprs import nan_to_null, q
from loomstat.session import local_rows

BINS = 4096
DIRECT_ROWS = 200_000
#: Up to this many columns ``column_sums`` aggregates side by side.
SIDE_BY_SIDE = 12
_FLOAT_MAX = 1.7976931348623157e308


@dataclass(frozen=True)
class _Bracket:
    """Values ``lo..hi`` of one column; ``before`` rows are smaller, ``n`` inside."""

    id: int
    pos: int
    lo: float
    hi: float
    before: int
    n: int


def long_values(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """``(keep, pos, value)`` rows, missing values left out; ``pos`` is the place
    of the column in ``cols`` (a small integer groups faster than a name)."""
    doubles = F.array(*[q(c).cast("double") for c in cols])
    rows = df.select(*keep, F.posexplode(doubles).alias("pos", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def column_sums(df: DataFrame, cols: Sequence[str], sums: Callable[[Column], list[Column]], by: Sequence[str] = ()) -> DataFrame:
    """``(by, pos, n, sums)`` of each column with any value, from one pass: side
    by side for a few columns, else from a row per value."""
    counted = lambda v: [F.count(v).alias("n"), *sums(v)]
    if len(cols) > SIDE_BY_SIDE:
        return long_values(df, cols, *by).groupBy(*by, "pos").agg(*counted(F.col("value")))
    each = [F.struct(F.lit(i).alias("pos"), *counted(nan_to_null(q(c).cast("double")))) for i, c in enumerate(cols)]
    if not each:
        each = [F.struct(F.lit(0).alias("pos"), *counted(F.lit(None).cast("double")))]
    return df.groupBy(*by).agg(F.array(*each).alias("_sums")).select(*by, F.inline("_sums")).where("n > 0")


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    bins: int = BINS,
    direct_rows: int = DIRECT_ROWS,
    spans: Mapping[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, nulls and NaN ignored.

    ``spans`` gives the count, minimum and maximum of each column when an
    earlier pass already took them.
    """
    if not cols:
        return {}
    values = long_values(df, cols)
    if spans is None:
        ends = column_sums(df, cols, lambda v: [F.min(v).alias("lo"), F.max(v).alias("hi")])
        live = [_Bracket(i, r["pos"], r["lo"], r["hi"], 0, r["n"]) for i, r in enumerate(ends.collect())]
    else:
        live = [_Bracket(i, i, spans[c][1], spans[c][2], 0, spans[c][0]) for i, c in enumerate(cols) if spans[c][0]]
    size = {b.pos: b.n for b in live}
    wanted = {v: sorted({k for p in probs for k in _ranks(n, p)}) for v, n in size.items()}
    found: dict[tuple[int, int], float] = {}

    rows = values.join(_bracket_table(df, live), "pos").select("bracket", "lo", "hi", "value") if live else None
    while True:
        live = _settle_flat(live, wanted, found)
        if not any(b.n > direct_rows for b in live):
            break
        # no more bins than it takes to come well below the direct limit
        needed = 8 * max(b.n for b in live) // direct_rows
        rows, live = _split(rows, live, wanted, min(bins, max(64, needed)))
    if live:
        _read_ranks(rows, live, wanted, found)
    return {c: [_interpolate(found, i, size.get(i, 0), p) for p in probs] for i, c in enumerate(cols)}


def _ranks(n: int, p: float) -> tuple[int, int]:
    k = min(int(math.floor((n - 1) * p)), n - 1)
    return k, min(k + 1, n - 1)


def _interpolate(found: dict, col: int, n: int, p: float) -> float | None:
    if n == 0:
        return None
    k, above = _ranks(n, p)
    low, high = found[col, k], found[col, above]
    share = (n - 1) * p - k
    return low if share == 0 or low == high else low + (high - low) * share


def _inside(b: _Bracket, wanted: dict[int, list[int]]) -> list[int]:
    return [k for k in wanted[b.pos] if b.before <= k < b.before + b.n]


def _settle_flat(live: list[_Bracket], wanted: dict, found: dict) -> list[_Bracket]:
    """A bracket with one distinct value answers its ranks at once."""
    rest = []
    for b in live:
        if b.lo == b.hi:
            found.update({(b.pos, k): b.lo for k in _inside(b, wanted)})
        else:
            rest.append(b)
    return rest


def _bracket_table(df: DataFrame, live: list[_Bracket]) -> DataFrame:
    # at most one row per (column, wanted rank), hence the broadcast
    rows = [(b.id, b.pos, b.lo, b.hi) for b in live]
    return F.broadcast(local_rows(df.sparkSession, rows, "bracket int, pos int, lo double, hi double"))


def _split(rows: DataFrame, live: list[_Bracket], wanted: dict, bins: int) -> tuple[DataFrame, list[_Bracket]]:
    """One refinement pass: count per bin, keep the bins that hold wanted ranks."""
    # halves keep the width finite for any pair of doubles; infinities land in the end bins
    low = F.greatest(F.col("lo"), F.lit(-_FLOAT_MAX)) / 2
    high = F.least(F.col("hi"), F.lit(_FLOAT_MAX)) / 2
    share = F.try_divide(F.col("value") / 2 - low, high - low)
    inner = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins)))
    # both ends are pinned to different bins, so every pass splits something
    bin_no = (
        F.when(F.col("value") <= F.col("lo"), F.lit(0))
        .when(F.col("value") >= F.col("hi"), F.lit(bins - 1))
        .otherwise(inner)
        .cast("int")
    )
    open_ids = [b.id for b in live]
    binned = rows.where(F.col("bracket").isin(open_ids)).withColumn("bin", bin_no)
    counts = binned.groupBy("bracket", "bin").agg(
        F.count("*").alias("n"), F.min("value").alias("bin_lo"), F.max("value").alias("bin_hi")
    )
    running = Window.partitionBy("bracket").orderBy("bin")  # at most ``bins`` rows each
    counts = counts.withColumn("upto", F.sum("n").over(running))
    ranks = [(b.id, b.before, k) for b in live for k in _inside(b, wanted)]
    rank_table = local_rows(rows.sparkSession, ranks, "bracket int, base bigint, rank bigint")
    hits = (
        counts.join(F.broadcast(rank_table), "bracket")
        .where((F.col("rank") >= F.col("base") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("base") + F.col("upto")))
        .select("bracket", "bin", "n", "bin_lo", "bin_hi", (F.col("base") + F.col("upto") - F.col("n")).alias("before"))
        .distinct()
        .collect()
    )
    names = {b.id: b.pos for b in live}
    nxt = [
        (r["bracket"], r["bin"], _Bracket(i, names[r["bracket"]], r["bin_lo"], r["bin_hi"], r["before"], r["n"]))
        for i, r in enumerate(hits)
    ]
    lookup = local_rows(
        rows.sparkSession,
        [(parent, bin_, b.id, b.lo, b.hi) for parent, bin_, b in nxt],
        "bracket int, bin int, child int, child_lo double, child_hi double",
    )
    narrowed = binned.join(F.broadcast(lookup), ["bracket", "bin"]).select(
        F.col("child").alias("bracket"), F.col("child_lo").alias("lo"), F.col("child_hi").alias("hi"), "value"
    )
    return narrowed, [b for _, _, b in nxt]


def _read_ranks(rows: DataFrame, live: list[_Bracket], wanted: dict, found: dict) -> None:
    """Order the few rows of each remaining bracket and read the ranks off."""
    place = Window.partitionBy("bracket").orderBy("value")
    by_id = {b.id: b for b in live}
    ranks = local_rows(
        rows.sparkSession,
        [(b.id, k - b.before + 1) for b in live for k in _inside(b, wanted)],
        "bracket int, place int",
    )
    ordered = rows.where(F.col("bracket").isin(list(by_id))).select(
        "bracket", "value", F.row_number().over(place).alias("place")
    )
    for r in ordered.join(F.broadcast(ranks), ["bracket", "place"]).collect():
        b = by_id[r["bracket"]]
        found[b.pos, b.before + r["place"] - 1] = r["value"]
