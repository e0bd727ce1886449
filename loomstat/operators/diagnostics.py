"""Residual tests and residual plots-as-tables of a fitted model."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import tails
from loomstat.functions.exprs import q
from loomstat.operators.gram import Moments, condition_number, moments
from loomstat.operators.models import least_squares, loglik_aic, loglik_bic
from loomstat.operators.ordering import lagged, ntile
from loomstat.operators.quantile import exact_quantiles
from loomstat.session import local_rows


def jarque_bera(df: DataFrame, resid: str = "resid") -> DataFrame:
    """``(n, skewness, kurtosis, jb, p_value)``; kurtosis of a normal is 3."""
    e = q(resid)
    shape = df.agg(F.count(e).alias("n"), F.skewness(e).alias("skewness"), (F.kurtosis(e) + 3).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow(F.col("kurtosis") - 3, F.lit(2.0)) / 4)
    return shape.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))


def durbin_watson(df: DataFrame, order_by: Sequence[str], resid: str = "resid") -> DataFrame:
    """Squared steps over squared residuals, in time order."""
    kept = df.select(*[q(c) for c in order_by], q(resid).alias("e")).where(F.col("e").isNotNull())
    steps = lagged(kept, "e", order_by, output="before")
    step = F.col("e") - F.col("before")
    return steps.agg(F.count("*").alias("n"), F.try_divide(F.sum(step * step), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"))


def breusch_pagan(df: DataFrame, features: Sequence[str], resid: str = "resid") -> DataFrame:
    """Squared residuals regressed on the features: ``LM = n R2``, chi-square
    with one degree of freedom per independent feature."""
    spark = df.sparkSession
    lm = p = math.nan
    n, k = 0, len(features)
    aux = df.select(*[q(c) for c in features], (q(resid) * q(resid)).alias("_e2"))
    try:
        fit = least_squares(moments(aux, features, "_e2"))
        n, k = int(fit.n), fit.rank - 1
        if fit.tss > 0 and k > 0:
            lm = fit.n * (1.0 - fit.rss / fit.tss)
            p = tails.chi2_tail(lm, k)
    except ValueError:
        pass
    return local_rows(spark, [(n, k, _or_none(lm), _or_none(p))], "n bigint, df int, lm double, p_value double")


def _or_none(x: float) -> float | None:
    return None if x is None or math.isnan(x) else x


def ols_summary(m: Moments, spark: SparkSession, rss: float | None = None) -> dict[str, float]:
    """Overall F test, fit measures and both likelihood criteria. ``rss`` from
    a residual pass replaces the one implied by the cross products."""
    fit = least_squares(m)
    rss = fit.rss if rss is None else rss
    n, k = fit.n, fit.rank - 1
    free = n - k - 1
    f = ((fit.tss - rss) / k) / (rss / free) if k and rss > 0 and free > 0 else math.nan
    r2 = 1.0 - rss / fit.tss if fit.tss > 0 else math.nan
    return {
        "condition_number": condition_number(m),
        "f_statistic": f,
        "f_pvalue": tails.f_tail(f, k, free) if k and free > 0 else math.nan,
        "r2": r2,
        "r2_adj": 1.0 - (1.0 - r2) * (n - 1) / free if free > 0 else math.nan,
        "aic_loglik": loglik_aic(n, rss, k) if rss > 0 else math.nan,
        "bic_loglik": loglik_bic(n, rss, k) if rss > 0 else math.nan,
        "rss": rss,
        "n": n,
    }


def coefficient_table(m: Moments, spark: SparkSession, rss: float | None = None) -> DataFrame:
    """``(feature, coef, std_err, t_value, p_value)``, the constant included.
    A feature that is a combination of others has no standard error."""
    import numpy as np

    fit = least_squares(m)
    free = fit.n - fit.rank
    s2 = (fit.rss if rss is None else rss) / free if free > 0 else math.nan
    # undo the column shifts in the constant's variance
    back = np.array([1.0, *[-m.shift.get(f, 0.0) for f in m.features]])
    var = s2 * np.diag(fit.inverse)
    var[0] = s2 * (back @ fit.inverse @ back)
    aliased = _aliased(m)
    coefs = dict(zip(m.features, fit.solution[1:]))
    values = [m.intercept(fit.solution[0], coefs), *coefs.values()]
    rows = []
    for name, b, v in zip(fit.names, values, var):
        se = None if name in aliased or not v > 0 else math.sqrt(v)
        t = None if se is None else b / se
        rows.append((name, float(b), se, t, None if t is None else tails.t_two_sided(t, free)))
    return local_rows(spark, rows, "feature string, coef double, std_err double, t_value double, p_value double")


def _aliased(m: Moments) -> set[str]:
    """Features whose spread the other features explain completely."""
    import numpy as np

    g = m.total[:-1, :-1]
    d = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    roots, vectors = np.linalg.eigh(g / np.outer(d, d))
    null = vectors[:, roots <= 1e-12 * max(roots[-1], 1e-300)]
    return {f for f, row in zip(["(intercept)", *m.features], np.abs(null) > 1e-6) if row.any()}


def qq_points(df: DataFrame, resid: str = "resid", points: int = 199) -> DataFrame:
    """``(point, theoretical, sample)``: quantiles of the standardised
    residuals at ``i/(points+1)`` against normal ones."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    e = q(resid)
    row = df.agg(F.avg(e).alias("m"), F.stddev_pop(e).alias("s")).first()
    mean, std = row["m"] or 0.0, row["s"] or 1.0
    sample = exact_quantiles(df, [resid], probs)[resid]
    rows = [
        (i + 1, p, tails.normal_quantile(p), None if v is None else (v - mean) / std)
        for i, (p, v) in enumerate(zip(probs, sample))
    ]
    return local_rows(df.sparkSession, rows, "point int, prob double, theoretical double, sample double")


def scale_location(df: DataFrame, resid: str = "resid", output: str = "scale_location") -> DataFrame:
    """Root of the absolute standardised residual of each row."""
    e = q(resid)
    row = df.agg(F.avg(e).alias("m"), F.stddev_pop(e).alias("s")).first()
    mean, std = row["m"] or 0.0, row["s"] or 1.0
    return df.withColumn(output, F.sqrt(F.abs((e - F.lit(mean)) / F.lit(std))))


def residual_trend(df: DataFrame, order_by: Sequence[str], fitted: str = "fitted", resid: str = "resid",
                   tiles: int = 50) -> DataFrame:
    """Mean fitted value and residual per equal-count tile of fitted values."""
    cols = dict.fromkeys([fitted, *order_by, resid])
    tiled = ntile(df.select(*[q(c) for c in cols]), [fitted, *order_by], tiles)
    return tiled.groupBy("tile").agg(
        F.count("*").alias("n"), F.avg(q(fitted)).alias("mean_fitted"), F.avg(q(resid)).alias("mean_resid")
    )


def residual_sequence(df: DataFrame, order_by: Sequence[str], n: int = 1000, resid: str = "resid") -> DataFrame:
    """The first ``n`` residuals in time order (a top-n, not a full sort)."""
    return df.select(*[q(c) for c in order_by], q(resid)).orderBy(*[q(c) for c in order_by]).limit(n)


def residual_tests(scored: DataFrame, features: Sequence[str], order_by: Sequence[str]) -> dict[str, float]:
    """Jarque-Bera, Durbin-Watson and Breusch-Pagan as one record."""
    jb, dw, bp = jarque_bera(scored).first(), durbin_watson(scored, order_by).first(), breusch_pagan(scored, features).first()
    return {
        "durbin_watson": dw["durbin_watson"],
        "jarque_bera_stat": jb["jb"],
        "jarque_bera_pvalue": jb["p_value"],
        "skewness": jb["skewness"],
        "kurtosis": jb["kurtosis"],
        "breusch_pagan_stat": bp["lm"],
        "breusch_pagan_pvalue": bp["p_value"],
    }
