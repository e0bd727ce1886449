"""Least squares and ridge without a cross-product matrix: conjugate gradients.

A solve needs products ``X'(X v)`` only. Each is one pass over the rows: the
direction goes to the tasks, every task multiplies its batches twice and leaves
one vector. Per iteration a few vectors of one number per feature exist on the
driver and in a task, so the number of features is bounded by what a row may
hold rather than by its square. Several penalties are solved together, one
column of a block each, and share the passes.

Features enter as ``(x - mean) / scale``. Columns then have equal length, which
is the diagonal preconditioning, and starting from zero the iterates stay in
the span of the rows, so collinear columns share their effect as they do in the
pseudo-inverse solution.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import kernels
from loomstat.functions.exprs import q
from loomstat.operators.clean import fit_scale
from loomstat.operators.models import Regression


@dataclass
class Solutions:
    """Per penalty: intercept and coefficients in the features' own units, and how the search ended."""

    features: list[str]
    intercepts: np.ndarray
    coefs: np.ndarray
    passes: int
    residuals: np.ndarray
    converged: bool


def _summed(rows: DataFrame, kernel, length: int, width: int) -> np.ndarray:
    """Add up one vector block per task; the sum runs over cells, not over whole vectors."""
    partial = rows.mapInArrow(kernel, "start int, values array<double>")
    cells = partial.select("start", F.posexplode("values").alias("k", "v")).groupBy((F.col("start") + F.col("k")).alias("at")).agg(F.sum("v").alias("v"))
    got = cells.toArrow()
    out = np.zeros(length * width)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(length, width)


def conjugate_gradient(df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float] = (0.0,),
                       tolerance: float = 1e-12, max_passes: int = 500) -> Solutions:
    """Minimise ``|y - X b|^2 + alpha |b|^2`` over standardised features for every
    penalty, over the rows that have all columns.

    A penalty is settled once its residual is ``tolerance`` of ``X'y``, or no
    further gain is possible in its precision; the worst residual is returned.
    """
    cols, p = [*features, label], len(features)
    # tasks leave incomplete rows out: of a condition on all columns the optimizer keeps a copy for
    # every subset of those that are computed, which filled the driver's memory at nine features
    rows = df.select(F.array(*[q(c).cast("double") for c in cols]).alias("x"))
    there = rows.mapInArrow(kernels.complete_lists(len(cols)), "x array<double>")
    names = [f"x{i}" for i in range(len(cols))]
    scale = list(fit_scale(there.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(names)]), names).values())
    n = there.count()
    if n == 0:
        raise ValueError("no complete rows to fit on")
    mean = np.array([m for m, _ in scale[:-1]])
    # a column without spread takes no part
    spread = np.array([s if s and s > 1e-12 * max(abs(m), 1e-300) else math.inf for m, s in scale[:-1]])
    y_mean = scale[-1][0]
    centre = np.append(mean, y_mean)
    spark, a = df.sparkSession, np.asarray(alphas, float)
    units = np.append(spread, 1.0)

    def product(v: np.ndarray) -> np.ndarray:
        shipped = spark.sparkContext.broadcast((centre, units, v))
        try:
            return _summed(rows, kernels.normal_product(shipped), p, v.shape[1])
        finally:
            shipped.destroy()

    shipped = spark.sparkContext.broadcast((centre, units, None))
    try:
        target = _summed(rows, kernels.normal_product(shipped), p, 1)
    finally:
        shipped.destroy()
    b = np.zeros((p, len(a)))
    r = np.repeat(target, len(a), axis=1)
    d, rr = r.copy(), (r * r).sum(axis=0)
    goal, best, passes = tolerance ** 2 * float((target ** 2).sum()), rr.copy(), 2
    live = rr > goal
    since = np.zeros(len(a), int)
    while live.any() and passes < max_passes:
        at = np.flatnonzero(live)
        step = product(d[:, at]) + a[at] * d[:, at]
        passes += 1
        curve = (d[:, at] * step).sum(axis=0)
        flat = curve <= 1e-300
        length = np.where(flat, 0.0, rr[at] / np.where(flat, 1.0, curve))
        b[:, at] += length * d[:, at]
        r[:, at] -= length * step
        now = (r[:, at] ** 2).sum(axis=0)
        d[:, at] = r[:, at] + now / rr[at] * d[:, at]
        rr[at] = now
        since[at] = np.where(now < 0.25 * best[at], 0, since[at] + 1)
        best[at] = np.minimum(best[at], now)
        # rounding keeps an ill-conditioned residual from falling any further
        live[at] = (now > goal) & ~flat & ~((since[at] > 20) & (now < 1e-16 * (target ** 2).sum()))
    off = np.sqrt(rr / max(float((target ** 2).sum()), 1e-300))
    converged = not live.any()
    if not converged:
        warnings.warn(f"conjugate gradients ended after {passes} passes, residual {off.max():.1e}", stacklevel=2)
    coefs = (b / spread[:, None]).T
    return Solutions(list(features), y_mean - coefs @ mean, coefs, passes, off, converged)


class IterativeLeastSquares(Regression):
    """Least squares, or ridge of one penalty, for more features than their matrix fits on the driver."""

    key, name = "ols_iterative", "Regresion Lineal MCO (OLS)"

    def __init__(self, name: str | None = None, alpha: float = 0.0, tolerance: float = 1e-12):
        super().__init__(name)
        self.alpha, self.tolerance, self.passes = alpha, tolerance, 0

    def fit(self, m, spark: SparkSession) -> "IterativeLeastSquares":
        raise TypeError("this model is fitted from rows: use fit_rows")

    def fit_rows(self, df: DataFrame, features: Sequence[str], label: str) -> "IterativeLeastSquares":
        found = conjugate_gradient(df, features, label, [self.alpha], self.tolerance)
        self.intercept, self.coefs, self.passes = float(found.intercepts[0]), dict(zip(features, map(float, found.coefs[0]))), found.passes
        return self

    def parameters(self) -> dict[str, object]:
        return {"lambda": self.alpha, "passes": self.passes}
