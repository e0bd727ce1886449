"""Descriptive tables of single columns and of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.exprs import nan_to_null, q
from loomstat.operators.clean import numeric_columns
from loomstat.operators.quantile import exact_quantiles, long_values
from loomstat.session import local_rows

QUARTILES = (0.25, 0.5, 0.75)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[q(c) for c in order_by]).limit(n)


def schema_inventory(df: DataFrame) -> DataFrame:
    """``(position, variable, type, n_rows, n_present)`` of each column."""
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("variable"), F.lit(f.dataType.simpleString()).alias("type"),
            F.count("*").alias("n_rows"), F.count(q(f.name)).alias("n_present"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of each numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    got = {r["pos"]: r for r in long_values(df, cols).groupBy("pos").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    ).collect()}
    spans = {c: (got[i]["n"], got[i]["lo"], got[i]["hi"]) if i in got else (0, None, None) for i, c in enumerate(cols)}
    quartiles = exact_quantiles(df, cols, QUARTILES, spans=spans)
    rows = [
        (c, spans[c][0], *((got[i]["mean"], got[i]["std"]) if i in got else (None, None)), spans[c][1], *quartiles[c], spans[c][2])
        for i, c in enumerate(cols)
    ]
    return local_rows(
        df.sparkSession, rows,
        "variable string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double",
    )


def target_kpis(df: DataFrame, col: str, limit: float) -> DataFrame:
    """Mean, maximum, and how often the design limit is exceeded."""
    v = nan_to_null(q(col).cast("double"))
    over = F.count_if(v > limit)
    return df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), over.alias("n_over"),
        (over / F.nullif(F.count(v), F.lit(0))).alias("share_over"),
    ).withColumn("design_limit", F.lit(float(limit)))


def _span(df: DataFrame, col: str) -> tuple[float, float] | None:
    v = nan_to_null(q(col).cast("double"))
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """``(bin, lo, hi, n)`` over equal bins; the last one includes its end.
    Empty bins are listed. One distinct value gets a unit-wide range."""
    span = _span(df, col)
    if span is None:
        return local_rows(df.sparkSession, [], "bin int, lo double, hi double, n bigint")
    lo, hi = span if span[0] < span[1] else (span[0] - 0.5, span[0] + 0.5)
    v = nan_to_null(q(col).cast("double"))
    number = F.least(F.floor((v - lo) / (hi - lo) * bins) + 1, F.lit(bins)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    width = (hi - lo) / bins
    edges = local_rows(df.sparkSession, [(i + 1, lo + i * width, lo + (i + 1) * width) for i in range(bins)],
                       "bin int, lo double, hi double")
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def kde(df: DataFrame, col: str, grid: int = 200, bins: int = 1024) -> DataFrame:
    """``(point, x, density)`` of a Gaussian kernel estimate, Scott's bandwidth.

    Rows are first reduced to ``bins`` counts with their mean value; each bin
    then spreads over the grid, so the work after the scan is bins x grid."""
    v = nan_to_null(q(col).cast("double"))
    row = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("s")).first()
    empty = local_rows(df.sparkSession, [], "point int, x double, density double")
    if not row["n"] or not row["s"]:
        return empty
    n, lo, hi = row["n"], row["lo"], row["hi"]
    h = row["s"] * n ** -0.2
    number = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    cells = df.where(v.isNotNull()).groupBy(number.alias("cell")).agg(F.count("*").alias("w"), F.avg(v).alias("c"))
    step = (hi - lo) / (grid - 1)
    spread = cells.select("w", "c", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    x = F.lit(lo) + F.col("point") * F.lit(step)
    kernel = F.exp(F.lit(-0.5) * F.pow((x - F.col("c")) / h, F.lit(2.0)))
    scale = 1.0 / (n * h * 2.5066282746310002)
    return (
        spread.withColumn("k", F.col("w") * kernel)
        .groupBy("point")
        .agg((F.sum("k") * scale).alias("density"))
        .select("point", x.alias("x"), "density")
    )


def box_stats(df: DataFrame, col: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, mean, whiskers (last reading within ``reach`` IQRs) and the
    number of readings beyond them."""
    q1, q2, q3 = exact_quantiles(df, [col], QUARTILES)[col]
    v = nan_to_null(q(col).cast("double"))
    if q1 is None:
        low = high = None
    else:
        low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    inside = v.between(F.lit(low).cast("double"), F.lit(high).cast("double"))
    return df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.lit(q1).cast("double").alias("q1"), F.lit(q2).cast("double").alias("median"), F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(v.isNotNull() & ~inside).alias("n_outliers"),
    )
