"""The linear regression family, fitted from cross products.

One pass over the rows (``gram.moments``, grouped by fold) feeds every model:
candidates, penalties, mixing ratios and folds are solved from those sums
without touching the rows again.
"""

from __future__ import annotations

import math
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.functions import kernels
from loomstat.functions.exprs import balanced_sum, log_grid_values, nan_to_null, q
from loomstat.operators.gram import NARROW, Moments
from loomstat.session import local_rows

ALIASED = 1e-10  # share of a column's spread left after the others explain it


def linear_predictor(intercept: float, coefs: Mapping[str, float], columns: Sequence[str]) -> Column:
    """``intercept + sum(coef * column)``; a column the table lacks counts as 0."""
    terms = [F.lit(float(b)) * (q(c) if c in columns else F.lit(0.0)) for c, b in coefs.items()]
    return F.lit(float(intercept)) + balanced_sum(terms)


@dataclass
class Weights:
    """Several linear models as one features x models matrix."""

    features: list[str]
    weights: np.ndarray
    used: np.ndarray
    intercepts: np.ndarray

    @classmethod
    def of(cls, models: Sequence["Regression"], columns: Sequence[str]) -> "Weights":
        """Of the features that any model knows and the table has; absent ones count as 0."""
        for m in models:
            m._require_fit()
        there = set(columns)
        features = list(dict.fromkeys(f for m in models for f in m.coefs if f in there))
        weights = np.array([[m.coefs.get(f, 0.0) for m in models] for f in features]).reshape(len(features), len(models))
        used = np.array([[float(f in m.coefs) for m in models] for f in features]).reshape(weights.shape)
        return cls(features, weights, used, np.array([m.intercept for m in models]))

    @property
    def wide(self) -> bool:
        """Above a few columns a matrix product replaces one expression per model."""
        return len(self.features) > NARROW

    def row(self) -> Column:
        return F.array(*[q(f).cast("double") for f in self.features])


def predictions(df: DataFrame, models: Sequence["Regression"], outputs: Sequence[str]) -> DataFrame:
    """``df`` with a prediction column per model. Wide tables multiply batches
    of rows by the matrix of all models; only the features go to Python."""
    w = Weights.of(models, df.columns)
    if not w.wide:
        return df.withColumns({name: m.prediction(df.columns) for name, m in zip(outputs, models)})
    fits = F.arrow_udf(kernels.fits_of(w.weights, w.used, w.intercepts), "array<double>")
    return df.withColumn("_fits", fits(w.row())).withColumns({name: F.get("_fits", F.lit(k)) for k, name in enumerate(outputs)}).drop("_fits")


class Regression(ABC):
    """What every model offers: fit, predict, coefficients, parameters."""

    key: str
    name: str

    def __init__(self, name: str | None = None):
        self.name = name or type(self).name
        self.intercept: float | None = None
        self.coefs: dict[str, float] | None = None

    @property
    def is_fitted(self) -> bool:
        return self.coefs is not None

    def _require_fit(self) -> None:
        if not self.is_fitted:
            raise RuntimeError(f"model {self.name!r} must be fitted first")

    @abstractmethod
    def fit(self, m: Moments, spark: SparkSession) -> "Regression":
        """Solve from the cross products of the training rows."""

    def _accept(self, m: Moments, features: Sequence[str], solution: Sequence[float]) -> "Regression":
        coefs = dict(zip(features, map(float, solution[1:])))
        self.intercept = m.intercept(float(solution[0]), coefs)
        self.coefs = coefs
        return self

    def predict(self, df: DataFrame, output: str = "fitted") -> DataFrame:
        return predictions(df, [self], [output])

    def prediction(self, columns: Sequence[str]) -> Column:
        self._require_fit()
        return linear_predictor(self.intercept, self.coefs, columns)

    def residuals(self, df: DataFrame, label: str, output: str = "resid") -> DataFrame:
        return self.predict(df).withColumn(output, q(label) - F.col("fitted"))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        self._require_fit()
        rows = [(self.key, f, b) for f, b in self.coefs.items()]
        return local_rows(spark, rows, "model string, feature string, coef double")

    def selected(self) -> list[str]:
        self._require_fit()
        return [f for f, b in self.coefs.items() if b != 0]

    def parameters(self) -> dict[str, object]:
        return {}

    def _sparsity(self) -> float:
        return 100.0 * (1.0 - len(self.selected()) / len(self.coefs)) if self.coefs else 0.0


# ---------------------------------------------------------------- least squares


@dataclass
class LeastSquares:
    """A least-squares solution and the quantities inference needs."""

    names: list[str]
    solution: np.ndarray
    inverse: np.ndarray
    rank: int
    n: float
    rss: float
    tss: float


def least_squares(m: Moments) -> LeastSquares:
    """Solve by pseudo-inverse, so collinear columns share their effect.

    Columns are scaled to unit length first; otherwise a column measured in
    large units would hide a small one below the rank cut."""
    g = m.total
    a, b, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    unit = a / np.outer(d, d)
    cut = 1e-12
    inverse = np.linalg.pinv(unit, rcond=cut, hermitian=True) / np.outer(d, d)
    rank = int((np.linalg.eigvalsh(unit) > cut * np.linalg.norm(unit, 2)).sum())
    w = inverse @ b
    fit = np.append(w, -1.0)
    tss = yy - b[0] ** 2 / a[0, 0]
    return LeastSquares(["(intercept)", *m.features], w, inverse, rank, float(a[0, 0]), float(max(fit @ g @ fit, 0.0)), float(tss))


class OrdinaryLeastSquares(Regression):
    key, name = "ols", "Regresion Lineal MCO (OLS)"

    def fit(self, m: Moments, spark: SparkSession) -> "OrdinaryLeastSquares":
        return self._accept(m, m.features, least_squares(m).solution)


# ---------------------------------------------------------------- stepwise


def loglik_aic(n: float, rss: float, k: int) -> float:
    """AIC of a Gaussian fit with ``k`` features and a constant."""
    return n * math.log(2 * math.pi) + n * math.log(rss / n) + n + 2 * (k + 1) if rss > 0 else -math.inf


def loglik_bic(n: float, rss: float, k: int) -> float:
    return loglik_aic(n, rss, k) + (math.log(n) - 2) * (k + 1)


def _pivot(t: np.ndarray, k: int) -> None:
    """Regress every other column on column ``k`` in place; again undoes it."""
    d = t[k, k]
    row, column = t[k].copy(), t[:, k].copy()
    t -= np.outer(column, row) / d
    t[k], t[:, k] = row / d, column / d
    t[k, k] = -1.0 / d


class StepwiseAIC(Regression):
    """Add the feature that lowers AIC most; after each addition drop at most
    one earlier feature if that lowers AIC again."""

    key, name = "stepwise", "Regresion Stepwise (AIC)"

    def __init__(self, name: str | None = None, max_features: int = 35, direction: str = "both"):
        super().__init__(name)
        if direction not in ("both", "forward"):
            raise ValueError("direction must be 'both' or 'forward'")
        self.max_features, self.direction = max_features, direction
        self.history: list[tuple[int, str, str | None, float]] = []  # step, action, feature, criterion
        self.aic = math.nan
        self.order: list[str] = []

    def fit(self, m: Moments, spark: SparkSession) -> "StepwiseAIC":
        n, _, t = kernels.centred(m.total)
        y = len(m.features)
        spread = np.diag(t).copy()
        chosen: list[int] = []
        waiting = list(range(y))
        best = loglik_aic(n, t[y, y], 0)
        self.history = [(0, "base", None, best)]
        step = 0
        while waiting and len(chosen) < self.max_features:
            step += 1
            trials = {
                j: loglik_aic(n, t[y, y] - t[j, y] ** 2 / t[j, j], len(chosen) + 1)
                for j in waiting
                if spread[j] > 0 and t[j, j] > ALIASED * spread[j]
            }
            add = min(trials, key=trials.get, default=None)
            if add is None or not trials[add] < best:
                break
            _pivot(t, add)
            chosen.append(add)
            waiting.remove(add)
            best = trials[add]
            self.history.append((step, "add", m.features[add], best))
            if self.direction == "both" and len(chosen) > 2:
                # a swept column's diagonal is minus its inverse entry
                trials = {
                    j: loglik_aic(n, t[y, y] - t[j, y] ** 2 / t[j, j], len(chosen) - 1) for j in chosen[:-1]
                }
                drop = min(trials, key=trials.get)
                if trials[drop] < best:
                    _pivot(t, drop)
                    chosen.remove(drop)
                    waiting.append(drop)
                    best = trials[drop]
                    self.history.append((step, "remove", m.features[drop], best))
        self.order = [m.features[j] for j in chosen]
        final = least_squares(m.restricted(self.order))
        self.aic = loglik_aic(final.n, final.rss, len(self.order))
        return self._accept(m, self.order, final.solution)

    def path(self, spark: SparkSession) -> DataFrame:
        """``(step_no, step, action, feature, aic, gain)`` of the search."""
        gains = [None, *[a[3] - b[3] for a, b in zip(self.history, self.history[1:])]]
        rows = [(i, step, action, feature, aic, gain) for i, ((step, action, feature, aic), gain) in enumerate(zip(self.history, gains))]
        return local_rows(spark, rows, "step_no int, step int, action string, feature string, aic double, gain double")

    def parameters(self) -> dict[str, object]:
        return {
            "criterio": "AIC",
            "num_variables_seleccionadas": len(self.order),
            "variables_seleccionadas": self.order,
            "aic_final": self.aic,
        }


# ---------------------------------------------------------------- penalised


def search_grid(
    spark: SparkSession,
    m: Moments,
    grid: Sequence[tuple[float, Sequence[float]]],
    solver: str,
    max_iter: int = 15000,
    tol: float = 1e-10,
) -> DataFrame:
    """Solve every ``(ratio, alpha)`` for every left-out fold and for all rows.

    The grid is a table, one group per (fold, ratio); each group is one small
    Spark task that walks its alphas. ``(held, ratio, alpha_no, alpha, mse, fit,
    n_iter, converged, off_optimum)``.
    """
    held = [-1, *sorted(m.groups)]
    rows = [
        (g * len(held) + h, fold, float(ratio), a, float(alpha))
        for g, (ratio, alphas) in enumerate(grid)
        for h, fold in enumerate(held)
        for a, alpha in enumerate(alphas)
    ]
    table = local_rows(spark, rows, "task int, held int, ratio double, alpha_no int, alpha double")
    shipped = spark.sparkContext.broadcast(m.groups)  # features x features numbers per fold
    solve = kernels.path_task(shipped, solver, max_iter, tol)
    out = "held int, ratio double, alpha_no int, alpha double, mse double, fit array<double>, n_iter int, converged boolean, off_optimum double"
    return table.groupBy("task").applyInPandas(solve, out)


class Penalised(Regression):
    """Shared search: lowest mean fold error wins, the earlier grid point on a
    tie, then the fit on all rows at that point is taken."""

    solver: str

    def __init__(self, name: str | None = None, alphas: Sequence[float] | None = None, max_iter: int = 15000):
        super().__init__(name)
        self.alphas = None if alphas is None else list(alphas)
        self.max_iter = max_iter
        self.best_alpha = self.best_ratio = math.nan
        self.folds = 0
        self.errors: list[tuple[float, int, float, float]] = []
        self.progress: list[tuple[float, int, float, int, bool, float]] = []
        self.converged = True

    @abstractmethod
    def grid(self, m: Moments) -> list[tuple[float, Sequence[float]]]:
        """``(ratio, alphas)`` to try, in order of preference."""

    def fit(self, m: Moments, spark: SparkSession) -> "Penalised":
        grid = self.grid(m)
        rows = search_grid(spark, m, grid, self.solver, self.max_iter).collect()
        sums: dict[tuple[float, int], list[float]] = {}
        alpha_at, fits, worst = {}, {}, {}
        for r in rows:
            at = (r["ratio"], r["alpha_no"])
            alpha_at[at] = r["alpha"]
            sweeps, settled, off = worst.get(at, (0, True, 0.0))
            worst[at] = (max(sweeps, r["n_iter"]), settled and r["converged"], max(off, r["off_optimum"]))
            if r["held"] >= 0:
                sums.setdefault(at, []).append(r["mse"])
            else:
                fits[at] = r["fit"]
        order = [(float(ratio), a) for ratio, alphas in grid for a in range(len(alphas))]
        means = {at: math.fsum(sums[at]) / len(sums[at]) for at in order}
        best = min(order, key=means.get)
        self.errors = [(at[0], at[1], alpha_at[at], means[at]) for at in order]
        self.progress = [(at[0], at[1], alpha_at[at], *worst[at]) for at in order]
        self.best_ratio, self.best_alpha = best[0], alpha_at[best]
        self.folds = len(m.groups)
        self.converged = worst[best][1]
        if not self.converged:
            warnings.warn(f"{self.key}: the chosen fit did not settle in {self.max_iter} sweeps", stacklevel=2)
        return self._accept(m, m.features, fits[best])

    def error_table(self, spark: SparkSession) -> DataFrame:
        return local_rows(spark, self.errors, "ratio double, alpha_no int, alpha double, cv_mse double")

    def convergence_table(self, spark: SparkSession) -> DataFrame:
        """Per grid point, the worst of its folds: sweeps, whether all settled, distance from the optimality conditions."""
        return local_rows(spark, self.progress, "ratio double, alpha_no int, alpha double, n_iter int, converged boolean, off_optimum double")


class Ridge(Penalised):
    key, name, solver = "ridge", "Regresion Ridge (L2)", "ridge"

    def grid(self, m: Moments) -> list[tuple[float, Sequence[float]]]:
        return [(0.0, self.alphas or log_grid_values(-4, 4, 60))]

    def parameters(self) -> dict[str, object]:
        return {"regularizacion": "L2 (Ridge)", "lambda_optimo": self.best_alpha, "cv_folds": self.folds}


def alpha_path(m: Moments, ratio: float, count: int = 100, eps: float = 1e-3) -> list[float]:
    """From the smallest alpha that empties the model down to ``eps`` of it."""
    n, _, c = kernels.centred(m.total)
    top = float(np.abs(c[:-1, -1]).max() / (n * ratio))
    if top <= 0:
        return [np.finfo(float).resolution] * count
    return [top * eps ** (i / (count - 1)) for i in range(count)]


class ElasticNet(Penalised):
    key, name, solver = "elasticnet", "Regresion Elastic Net (L1+L2)", "net"
    label = "Elastic Net (L1+L2)"
    RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)

    def __init__(self, name: str | None = None, alphas: Sequence[float] | None = None,
                 ratios: Sequence[float] | None = None, max_iter: int = 15000):
        super().__init__(name, alphas, max_iter)
        self.ratios = tuple(ratios or self.RATIOS)

    def grid(self, m: Moments) -> list[tuple[float, Sequence[float]]]:
        if self.alphas is not None:
            return [(r, sorted(self.alphas, reverse=True)) for r in self.ratios]
        return [(r, alpha_path(m, r)) for r in self.ratios]

    def parameters(self) -> dict[str, object]:
        ratio = {"l1_ratio_optimo": self.best_ratio} if len(self.ratios) > 1 else {}
        return {
            "regularizacion": self.label,
            "lambda_optimo": self.best_alpha,
            **ratio,
            "num_variables_seleccionadas": len(self.selected()),
            "sparsity_pct": self._sparsity(),
            "cv_folds": self.folds,
        }


class Lasso(ElasticNet):
    key, name, label = "lasso", "Regresion Lasso (L1)", "L1 (Lasso)"
    RATIOS = (1.0,)


# ---------------------------------------------------------------- legacy variants


def ridge_leave_one_out(df: DataFrame, m: Moments, alphas: Sequence[float]) -> DataFrame:
    """``(alpha_no, alpha, loo_mse)``: exact leave-one-out error of each ridge
    penalty, from one further pass that turns residuals by their leverage."""
    alphas = [float(a) for a in alphas]
    cols = [*m.features, m.label]
    x = df.select(*[
        (nan_to_null(q(c).cast("double")) - F.lit(float(m.shift.get(c, 0.0)))).alias(f"x{i}") for i, c in enumerate(cols)
    ])
    partial = x.mapInArrow(kernels.leave_one_out_task(m.total, alphas), "sse array<double>")
    sums = partial.select(F.posexplode("sse").alias("alpha_no", "sse")).groupBy("alpha_no").agg(F.sum("sse").alias("sse"))
    grid = F.lit(alphas)
    return sums.select("alpha_no", F.element_at(grid, F.col("alpha_no") + 1).alias("alpha"), (F.col("sse") / m.n).alias("loo_mse"))


class RidgeLeaveOneOut(Regression):
    """Ridge whose penalty has the lowest leave-one-out error."""

    key, name = "ridge_loo", "Regresion Ridge (LOO)"

    def __init__(self, df: DataFrame, name: str | None = None, alphas: Sequence[float] | None = None):
        super().__init__(name)
        self.rows, self.alphas = df, list(alphas or log_grid_values(-6, 6, 13))
        self.best_alpha = math.nan

    def fit(self, m: Moments, spark: SparkSession) -> "RidgeLeaveOneOut":
        errors = ridge_leave_one_out(self.rows, m, self.alphas)
        self.best_alpha = errors.orderBy("loo_mse", "alpha_no").first()["alpha"]
        return self._accept(m, m.features, kernels.ridge_path(m.total, np.array([self.best_alpha]))[0])

    def parameters(self) -> dict[str, object]:
        return {"regularizacion": "L2 (Ridge)", "lambda_optimo": self.best_alpha}


def _trial_errors(train: np.ndarray, test: np.ndarray, spread: np.ndarray, chosen: list[int], trials: list[int]) -> np.ndarray:
    """Squared error on left-out rows of the fits that each trial column would
    make with the chosen ones. ``train`` is swept by the constant and by them, so a
    trial's coefficients follow from its own column; one product with the left-out
    sums scores all trials."""
    y, held = train.shape[0] - 1, [0, *chosen]
    at = np.array(trials)
    usable = train[at, at] > ALIASED * spread[at]
    slope = np.where(usable, train[at, y] / np.where(usable, train[at, at], 1.0), 0.0)  # an alias adds nothing
    w = np.zeros((y + 1, len(at)))
    w[held] = train[held, y][:, None] - train[np.ix_(held, at)] * slope
    w[at, np.arange(len(at))] = slope
    w[y] = -1.0
    return np.maximum((w * (test @ w)).sum(axis=0), 0.0)


class ForwardCV(Regression):
    """Greedy forward selection by mean fold score up to a feature count, then
    least squares on the selection."""

    key, name = "forward_cv", "Seleccion Secuencial (CV)"

    def __init__(self, name: str | None = None, n_features: int | float | str = "auto", scoring: str = "mse"):
        super().__init__(name)
        if scoring not in ("mse", "r2"):
            raise ValueError("scoring must be 'mse' or 'r2'")
        self.n_features, self.scoring = n_features, scoring
        self.order: list[str] = []
        self.scores: list[float] = []
        self.aic: float | None = None

    def _count(self, p: int) -> int:
        if self.n_features == "auto":
            return max(1, p // 2)
        if isinstance(self.n_features, float):
            return max(1, int(p * self.n_features))
        return min(int(self.n_features), p)

    def fit(self, m: Moments, spark: SparkSession) -> "ForwardCV":
        trains = {g: m.without(g).copy() for g in m.groups}
        for t in trains.values():
            _pivot(t, 0)
        spreads = {g: np.diag(t).copy() for g, t in trains.items()}
        chosen: list[int] = []
        self.scores = []
        while len(chosen) < self._count(len(m.features)):
            trials = [j for j in range(1, len(m.features) + 1) if j not in chosen]
            scores = np.zeros(len(trials))
            for g, test in m.groups.items():
                sse = _trial_errors(trains[g], test, spreads[g], chosen, trials)
                n = test[0, 0]
                scores += -sse / n if self.scoring == "mse" else 1.0 - sse / (test[-1, -1] - test[0, -1] ** 2 / n)
            best = int(np.argmax(scores))
            add = trials[best]
            for g, t in trains.items():
                if t[add, add] > ALIASED * spreads[g][add]:
                    _pivot(t, add)
            chosen.append(add)
            self.scores.append(float(scores[best]) / len(m.groups))
        self.order = [m.features[j - 1] for j in chosen]
        kept = [f for f in m.features if f in self.order]
        final = least_squares(m.restricted(kept))
        n, k = final.n, len(kept)
        self.aic = n * math.log(final.rss / n) + 2 * (k + 1) if final.rss > 0 else math.inf
        return self._accept(m, kept, final.solution)

    def path(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, f, s) for i, (f, s) in enumerate(zip(self.order, self.scores))]
        return local_rows(spark, rows, "step int, feature string, score double")

    def parameters(self) -> dict[str, object]:
        return {"criterio": f"CV {self.scoring}", "num_variables_seleccionadas": len(self.order), "variables_seleccionadas": self.order}


# ---------------------------------------------------------------- registry

REGISTRY: dict[str, Callable[..., Regression]] = {
    "ols": OrdinaryLeastSquares,
    "stepwise": StepwiseAIC,
    "ridge": Ridge,
    "lasso": Lasso,
    "elasticnet": ElasticNet,
}


def create_model(kind: str, **options) -> Regression:
    key = kind.lower().strip()
    if key not in REGISTRY:
        raise ValueError(f"unknown model {kind!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[key](**options)


def all_models() -> dict[str, Regression]:
    """The default suite of five."""
    return {key: make() for key, make in REGISTRY.items()}


def all_coefficients(models: Sequence[Regression], spark: SparkSession) -> DataFrame:
    rows = [(m.key, f, b) for m in models for f, b in m.coefs.items()]
    return local_rows(spark, rows, "model string, feature string, coef double")


def nonzero(coefs: DataFrame) -> DataFrame:
    return coefs.where("coef <> 0")


def top_coefficients(coefs: DataFrame, n: int = 15, by_abs: bool = False) -> DataFrame:
    """Largest coefficients of each model: ``n`` by magnitude, or the
    ``n // 2`` largest positive side and ``n // 2`` smallest side, each feature
    once. ``coefs`` has one row per model and feature."""
    live = nonzero(coefs)
    by_model = Window.partitionBy("model")
    if by_abs:
        place = F.row_number().over(by_model.orderBy(F.desc(F.abs("coef")), "feature"))
        return live.withColumn("rank", place).where(F.col("rank") <= n)
    half = n // 2
    high = live.withColumn("rank", F.row_number().over(by_model.orderBy(F.desc("coef"), "feature")))
    low = live.withColumn("rank", F.row_number().over(by_model.orderBy(F.asc("coef"), "feature")))
    both = high.where(F.col("rank") <= half).unionByName(low.where(F.col("rank") <= half))
    return both.select("model", "feature", "coef").distinct()
