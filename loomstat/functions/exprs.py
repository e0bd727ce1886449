"""Scalar expressions shared by the operators."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by exact name, whatever spaces, dots or accents it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_number(c: Column) -> Column:
    """Text to double; anything unreadable, and NaN, becomes null."""
    return nan_to_null(c.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    """Spark orders and averages NaN as a value; missing readings must be null."""
    return F.nullif(c, F.lit(float("nan")))


def rounded(c: Column, digits: int) -> Column:
    """Round and turn -0.0 into 0.0, so equal numbers print and hash alike."""
    return F.round(c, digits) + F.lit(0.0)


def key_digest(key: Column, seed: int) -> Column:
    """MD5 of ``seed:key`` in hex: the same on any partitioning, any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def digest_word(digest: Column, word: int) -> Column:
    """One of the four independent 8-digit words of a digest."""
    return F.substring(digest, 8 * word + 1, 8)


def hex_cut(share: float) -> str:
    """The 8-digit word below which a ``share`` of all words lies. Words of
    equal length compare as text in numeric order, which is cheaper than
    converting each to a number."""
    return format(min(round(share * 2**32), 2**32 - 1), "08x")


def literal_array(values: Sequence, kind: str) -> Column:
    """Driver-side values as one literal of the plan, however many they are."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def balanced_sum(terms: Sequence[Column]) -> Column:
    """Sum as a tree of logarithmic depth; a left fold over thousands of
    columns would overflow the analyzer's stack."""
    if not terms:
        return F.lit(0.0)
    level = list(terms)
    while len(level) > 1:
        paired = [a + b for a, b in zip(level[::2], level[1::2])]
        level = paired + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def log_grid(start: float, stop: float, count: int) -> Column:
    """Array of ``count`` powers of ten with evenly spaced exponents."""
    if count < 1:
        raise ValueError("count must be at least 1")
    step = (stop - start) / (count - 1) if count > 1 else 0.0
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.pow(F.lit(10.0), F.lit(float(start)) + i * F.lit(step)),
    )


def log_grid_values(start: float, stop: float, count: int) -> list[float]:
    """The same grid as plain numbers, for task-side solvers."""
    step = (stop - start) / (count - 1) if count > 1 else 0.0
    return [10.0 ** (start + i * step) for i in range(count)]


def sparsity_pct(kept: Column, total: Column) -> Column:
    return F.lit(100.0) * (F.lit(1.0) - kept / F.nullif(total, F.lit(0)))


def format_params(params: Column, omit: Iterable[str] = ("variables_seleccionadas",), empty: str = "N/A") -> Column:
    """``map<string,string>`` as ``k=v, k=v`` in key order; numbers with a
    decimal point get four decimals."""
    kept = F.map_filter(params, lambda k, _: ~k.isin(*omit))
    ordered = F.array_sort(F.map_entries(kept))
    text = F.concat_ws(
        ", ",
        F.transform(
            ordered,
            lambda e: F.concat(e["key"], F.lit("="), _four_decimals(e["value"])),
        ),
    )
    return F.when(params.isNull() | (text == ""), F.lit(empty)).otherwise(text)


def _four_decimals(v: Column) -> Column:
    is_float = v.rlike(r"^-?[0-9]+\.[0-9]+([eE][-+]?[0-9]+)?$|^-?[0-9]+[eE][-+]?[0-9]+$")
    return F.when(is_float, F.format_string("%.4f", v.try_cast("double"))).otherwise(v)


def rss_aic(n: Column, rss: Column, k: Column) -> Column:
    """``n ln(RSS/n) + 2(k+1)``; null when the fit is perfect."""
    return F.when(rss > 0, n * F.ln(rss / n) + F.lit(2.0) * (k + 1))


def rss_bic(n: Column, rss: Column, k: Column) -> Column:
    return F.when(rss > 0, n * F.ln(rss / n) + F.ln(n) * (k + 1))


def adjusted_r2(r2: Column, n: Column, k: Column) -> Column:
    """Unadjusted when there are too few rows for the correction."""
    return F.when(n > k + 1, F.lit(1.0) - (F.lit(1.0) - r2) * (n - 1) / F.nullif(n - k - 1, F.lit(0))).otherwise(r2)
