"""Upper-tail probabilities for a handful of test statistics.

They are evaluated once per fitted model (not per row), from the series and
continued fractions of the incomplete gamma and beta functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count
from statistics import NormalDist

TINY, CLOSE = 1e-300, 1e-15


def _fraction(first: float, terms: Iterator[tuple[float, float]]) -> float:
    """``first + a1 / (b1 + a2 / (b2 + ...))`` from its ``(a, b)``, by ratios of successive convergents."""
    value = first or TINY
    c, d = value, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        value *= c * d
        if abs(c * d - 1.0) < CLOSE:
            break
    return value


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for k in count(1):
            term *= x / (a + k)
            total += term
            if term < total * CLOSE:
                return 1.0 - scale * total
    return scale / _fraction(x + 1 - a, ((-k * (k - a), x + 2 * k + 1 - a) for k in count(1)))


def beta_lower(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(1 - x, b, a)

    def terms() -> Iterator[tuple[float, float]]:
        for m in count():
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            yield (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)), 1.0

    log = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log) / (a * _fraction(1.0, terms()))


def chi2_tail(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gamma_upper(df / 2.0, x / 2.0)


def f_tail(x: float, dfn: float, dfd: float) -> float:
    """P(F > x), taken as a lower beta tail: ``1 - cdf`` would round to zero."""
    if math.isnan(x):
        return math.nan
    return 0.0 if math.isinf(x) else beta_lower(dfd / (dfd + dfn * x), dfd / 2.0, dfn / 2.0)


def t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) else f_tail(t * t, 1.0, df)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
