"""Typing, dropping, imputing and scaling of wide tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.exprs import nan_to_null, q, to_number
from loomstat.operators.quantile import column_sums, exact_quantiles
from loomstat.session import local_rows

# ---------------------------------------------------------------- types


def clean_types(df: DataFrame, ts_col: str, drop: Iterable[str] = (), ts_name: str = "Timestamp",
                ts_format: str | None = None) -> DataFrame:
    """Drop unwanted columns, parse the time column (a bad value is an error)
    and turn every other column into a number or null."""
    kept = df.drop(*drop)
    if ts_col not in kept.columns:
        warnings.warn(f"time column {ts_col!r} is absent; no time axis was set", stacklevel=2)
        return kept.select(*[to_number(q(c)).alias(c) for c in kept.columns])
    # plant clocks carry no zone, so the result must not depend on the session's
    stamp = F.to_timestamp_ntz(q(ts_col), F.lit(ts_format)) if ts_format else q(ts_col).cast("timestamp_ntz")
    sensors = [c for c in kept.columns if c != ts_col]
    return kept.select(stamp.alias(ts_name), *[to_number(q(c)).alias(c) for c in sensors])


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn the named columns (all by default) into doubles, bad cells to null."""
    chosen = list(df.columns if cols is None else cols)
    return df.withColumns({c: to_number(q(c)) for c in chosen})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_time_axis(df: DataFrame, ts_col: str) -> DataFrame:
    kind = df.schema[ts_col].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{ts_col!r} is {kind.simpleString()}, not a timestamp")
    return df


# ---------------------------------------------------------------- rows


def drop_null_target(df: DataFrame, label: str) -> DataFrame:
    return df.where(nan_to_null(q(label)).isNotNull())


def drop_empty_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every (named) column is missing."""
    return df.dropna("all", subset=list(cols) if cols else None)


def resolve_target(columns: Sequence[str], requested: str, secondary: str | None = None) -> str:
    if requested in columns:
        return requested
    if secondary is not None and secondary in columns:
        warnings.warn(f"target {requested!r} is absent; using {secondary!r}", stacklevel=2)
        return secondary
    raise ValueError(f"target variable {requested!r} is not a column")


# ---------------------------------------------------------------- columns


def column_spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, n, lo, hi, std, var)`` of each column in one pass; a column
    without any value has ``n = 0``."""
    names = local_rows(df.sparkSession, list(enumerate(cols)), "pos int, variable string")
    stats = column_sums(df, cols, lambda v: [
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var")])
    return names.join(stats, "pos", "left").select(
        "variable", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "lo", "hi", "std", "var"
    )


def flag_uninformative(spread: DataFrame, std_tol: float = 1e-7, var_min: float | None = None) -> DataFrame:
    """Constant columns: at most one distinct value, or almost no spread.
    ``var_min`` switches to the plain variance threshold."""
    if var_min is not None:
        flag = F.col("var") < var_min if var_min > 0 else F.col("var") == 0
        flag = F.coalesce(flag, F.lit(False))
    else:
        flag = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)) | F.coalesce(F.col("std") <= std_tol, F.lit(False))
    return spread.withColumn("dropped", flag)


def constant_columns(df: DataFrame, label: str | None = None, std_tol: float = 1e-7,
                     var_min: float | None = None, cols: Sequence[str] | None = None) -> list[str]:
    """Names of the columns to drop; the label is never one of them."""
    chosen = [c for c in (cols if cols is not None else numeric_columns(df)) if c != label]
    flagged = flag_uninformative(column_spread(df, chosen), std_tol, var_min).where("dropped")
    hit = {r["variable"] for r in flagged.select("variable").collect()}
    return [c for c in chosen if c in hit]


def exclude_columns(columns: Sequence[str], names: Iterable[str] = (), contains: Iterable[str] = (),
                    keep: Iterable[str] = (), strict: bool = False) -> list[str]:
    """Columns left after dropping exact names and names holding a needle."""
    names, needles, safe = set(names), list(contains), set(keep)
    absent = sorted(names - set(columns))
    if strict and absent:
        raise KeyError(f"not in the table: {absent}")
    return [c for c in columns if c in safe or not (c in names or any(x in c for x in needles))]


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """``(variable, n_null)`` of each column from one scan."""
    chosen = list(df.columns if cols is None else cols)
    pairs = [F.struct(F.lit(c).alias("variable"), F.count_if(_missing(df, c)).alias("n_null")) for c in chosen]
    out = df.agg(F.array(*pairs).alias("s")).select(F.inline("s"))
    return out.where("n_null > 0") if only_missing else out


def _missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    return q(c).isNull() | F.isnan(q(c)) if floating else q(c).isNull()


def assert_no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> None:
    left = {r["variable"]: r["n_null"] for r in null_counts(df, cols).collect()}
    if left:
        raise ValueError(f"missing values remain: {left}")


@dataclass(frozen=True)
class Spread:
    """Count, range, mean and squared deviations of one column."""

    n: int = 0
    lo: float | None = None
    hi: float | None = None
    mean: float = 0.0
    m2: float = 0.0

    def __add__(self, other: "Spread") -> "Spread":
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = other.mean - self.mean
        return Spread(
            n, min(self.lo, other.lo), max(self.hi, other.hi), self.mean + gap * other.n / n,
            self.m2 + other.m2 + gap * gap * self.n * other.n / n,
        )

    def is_constant(self, std_tol: float) -> bool:
        if self.n <= 1 or self.lo == self.hi:
            return True
        return (self.m2 / (self.n - 1)) ** 0.5 <= std_tol


def spread_by(df: DataFrame, cols: Sequence[str], flag: Column) -> tuple[dict[str, Spread], dict[str, Spread]]:
    """Column spreads of the flagged rows and of the others, in one pass; their
    sum is the whole table's."""
    marked = df.select(F.coalesce(flag, F.lit(False)).alias("_flag"), *[q(c) for c in cols])
    stats = column_sums(marked, cols, lambda v: [
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")], ["_flag"])
    got = {(r["_flag"], r["pos"]): Spread(r["n"], r["lo"], r["hi"], r["mean"], r["m2"]) for r in stats.collect()}
    side = lambda f: {c: got.get((f, i), Spread()) for i, c in enumerate(cols)}
    return side(True), side(False)


# ---------------------------------------------------------------- impute / scale


def fit_median(df: DataFrame, cols: Sequence[str], spans: Mapping[str, Spread] | None = None) -> dict[str, float | None]:
    """Exact medians of the fitting rows; null for an all-missing column."""
    known = None if spans is None else {c: (spans[c].n, spans[c].lo, spans[c].hi) for c in cols}
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5], spans=known).items()}


def impute(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    filled = {
        c: F.coalesce(nan_to_null(q(c).cast("double")), F.lit(m).cast("double"))
        for c, m in medians.items()
    }
    return df.withColumns(filled) if filled else df


def fit_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, in one pass."""
    stats = column_sums(df, cols, lambda v: [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")])
    got = {r["pos"]: (r["mean"], r["std"]) for r in stats.collect()}
    return {c: got.get(i, (0.0, 0.0)) for i, c in enumerate(cols)}


def standardise(df: DataFrame, scale: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / std``; a column without spread is only centred."""
    scaled = {c: (q(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in scale.items()}
    return df.withColumns(scaled) if scaled else df
