import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from loomstat.functions.exprs import log_grid_values
from loomstat.operators import diagnostics, evaluate, gram, models

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark, dense):
    return spark.createDataFrame(dense).repartition(3).persist()


@pytest.fixture(scope="module")
def moments(frame):
    return gram.moments(frame, X, "y", "fold")


def direct(pdf, cols):
    z = np.column_stack([np.ones(len(pdf)), pdf[cols]])
    return np.linalg.lstsq(z, pdf["y"], rcond=None)[0]


def rss(pdf, cols):
    z = np.column_stack([np.ones(len(pdf)), pdf[list(cols)]]) if cols else np.ones((len(pdf), 1))
    w = np.linalg.lstsq(z, pdf["y"], rcond=None)[0]
    return float(((pdf["y"] - z @ w) ** 2).sum())


@pytest.mark.parametrize("narrow", [0, 8])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_moments_equal_numpy_whatever_the_partitions(frame, dense, narrow, parts):
    m = gram.moments(frame.repartition(parts), X, "y", "fold", {c: 0.0 for c in [*X, "y"]}, narrow)
    for g, got in m.groups.items():
        part = dense[dense.fold == g]
        z = np.column_stack([np.ones(len(part)), part[X], part["y"]])
        assert np.allclose(got, z.T @ z, atol=1e-9)


def test_ols_equals_lstsq(spark, moments, dense):
    ols = models.OrdinaryLeastSquares().fit(moments, spark)
    assert np.allclose([ols.intercept, *ols.coefs.values()], direct(dense, X), atol=1e-10)


def test_ols_takes_collinear_input_and_flags_it(spark, frame):
    twin = frame.selectExpr("*", "a * 2 + 1 as twin")
    m = gram.moments(twin, ["a", "twin", "b"], "y")
    ols = models.OrdinaryLeastSquares().fit(m, spark)
    alone = models.OrdinaryLeastSquares().fit(gram.moments(frame, ["a", "b"], "y"), spark)
    both = [m_.predict(twin).agg({"fitted": "sum"}).first()[0] for m_ in (ols, alone)]
    assert both[0] == pytest.approx(both[1], rel=1e-9)
    table = {r["feature"]: r for r in diagnostics.coefficient_table(m, spark).collect()}
    assert table["twin"]["std_err"] is None and table["b"]["std_err"] > 0


def test_unfitted_model_refuses(frame):
    with pytest.raises(RuntimeError):
        models.Ridge().predict(frame)


def test_ridge_closed_form_and_choice(spark, moments, dense):
    grid = log_grid_values(-2, 3, 12)
    ridge = models.Ridge(alphas=grid).fit(moments, spark)

    def fit(pdf, a):
        xc, yc = pdf[X] - pdf[X].mean(), pdf["y"] - pdf["y"].mean()
        b = np.linalg.solve(xc.T @ xc + a * np.eye(4), xc.T @ yc)
        return pdf["y"].mean() - pdf[X].mean() @ b, b

    errors = []
    for a in grid:
        per = []
        for f in range(5):
            b0, b = fit(dense[dense.fold != f], a)
            t = dense[dense.fold == f]
            per.append(((t["y"] - b0 - t[X] @ b) ** 2).mean())
        errors.append(np.mean(per))
    assert np.allclose([e[3] for e in ridge.errors], errors, rtol=1e-9)
    assert ridge.best_alpha == grid[int(np.argmin(errors))]
    assert np.allclose(list(ridge.coefs.values()), fit(dense, ridge.best_alpha)[1], atol=1e-9)


@pytest.mark.parametrize("ratio", [1.0, 0.5, 0.1])
def test_net_solution_is_stationary(spark, moments, dense, ratio):
    net = models.ElasticNet(alphas=[0.3], ratios=[ratio]).fit(moments, spark)
    b = np.array(list(net.coefs.values()))
    xc, yc = dense[X].to_numpy() - dense[X].mean().to_numpy(), dense["y"] - dense["y"].mean()
    slope = xc.T @ (yc - xc @ b) / len(dense) - 0.3 * (1 - ratio) * b
    on = b != 0
    assert np.allclose(slope[on], 0.3 * ratio * np.sign(b[on]), atol=1e-8)
    assert (np.abs(slope[~on]) <= 0.3 * ratio + 1e-8).all()


def test_lasso_agrees_with_spark_ml(spark, frame, moments):
    lasso = models.Lasso(alphas=[0.2]).fit(moments, spark)
    data = VectorAssembler(inputCols=X, outputCol="features").transform(frame)
    ml = LinearRegression(labelCol="y", regParam=0.2, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000).fit(data)
    assert np.allclose(list(lasso.coefs.values()), ml.coefficients.toArray(), atol=1e-5)


def test_net_path_defaults(spark, moments):
    path = models.alpha_path(moments, 0.5)
    assert len(path) == 100 and path[-1] == pytest.approx(path[0] * 1e-3)
    empty = models.ElasticNet(alphas=[path[0]], ratios=[0.5]).fit(moments, spark)
    assert empty.selected() == []


def test_stepwise_equals_refitting_search(spark, moments, dense):
    n = len(dense)
    aic = lambda cols: models.loglik_aic(n, rss(dense, cols), len(cols))
    chosen, waiting, best, history = [], list(X), aic([]), [(0, "base", None)]
    step = 0
    while waiting:
        step += 1
        trial = min(waiting, key=lambda c: aic([*chosen, c]))
        if not aic([*chosen, trial]) < best:
            break
        chosen.append(trial)
        waiting.remove(trial)
        best = aic(chosen)
        history.append((step, "add", trial))
        if len(chosen) > 2:
            drop = min(chosen[:-1], key=lambda c: aic([x for x in chosen if x != c]))
            if aic([x for x in chosen if x != drop]) < best:
                chosen.remove(drop)
                waiting.append(drop)
                best = aic(chosen)
                history.append((step, "remove", drop))
    got = models.StepwiseAIC().fit(moments, spark)
    assert [h[:3] for h in got.history] == history
    assert got.aic == pytest.approx(best, rel=1e-10)


def test_stepwise_drops_a_feature_made_redundant(spark):
    rng = np.random.default_rng(3)
    u, v, w = rng.normal(size=(3, 600))
    import pandas as pd

    pdf = pd.DataFrame({"mix": u + v + w + rng.normal(scale=0.3, size=600), "u": u, "v": v, "w": w})
    pdf["y"] = u + v + w + rng.normal(scale=0.1, size=600)
    m = gram.moments(spark.createDataFrame(pdf), ["mix", "u", "v", "w"], "y")
    got = models.StepwiseAIC().fit(m, spark)
    assert ("remove", "mix") in [h[1:3] for h in got.history]
    assert sorted(got.order) == ["u", "v", "w"]
    kept = models.StepwiseAIC(direction="forward").fit(m, spark)
    assert "mix" in kept.order
    assert len(models.StepwiseAIC(max_features=2).fit(m, spark).order) == 2


def test_subset_rss_from_one_pass(moments, dense):
    for k in range(1, 5):
        for cols in itertools.combinations(X, k):
            assert models.least_squares(moments.restricted(list(cols))).rss == pytest.approx(rss(dense, cols), rel=1e-9)


@pytest.mark.parametrize("scoring", ["mse", "r2"])
def test_forward_cv_equals_refitting_search(spark, moments, dense, scoring):
    def score(cols):
        per = []
        for f in range(5):
            tr, te = dense[dense.fold != f], dense[dense.fold == f]
            w = direct(tr, list(cols))
            e = te["y"] - np.column_stack([np.ones(len(te)), te[list(cols)]]) @ w
            per.append(-(e**2).mean() if scoring == "mse" else 1 - (e**2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum())
        return np.mean(per)

    chosen = []
    for _ in range(2):
        chosen.append(max((c for c in X if c not in chosen), key=lambda c: score([*chosen, c])))
    assert models.ForwardCV(scoring=scoring).fit(moments, spark).order == chosen


def test_leave_one_out_equals_refits(frame, moments, dense):
    got = {r["alpha"]: r["loo_mse"] for r in models.ridge_leave_one_out(frame, moments.merged(), [0.1, 10.0]).collect()}
    for a, value in got.items():
        errors = []
        for i in range(len(dense)):
            rest = dense.drop(index=i)
            xc, yc = rest[X] - rest[X].mean(), rest["y"] - rest["y"].mean()
            b = np.linalg.solve(xc.T @ xc + a * np.eye(4), xc.T @ yc)
            errors.append(dense["y"][i] - (yc.mean() + rest["y"].mean() + (dense.loc[i, X] - rest[X].mean()) @ b))
        assert value == pytest.approx(np.mean(np.square(errors)), rel=1e-8)


def test_standardised_moments_are_an_affine_change(spark, frame, moments, dense):
    z = moments.standardised()
    pdf = dense.copy()
    pdf[X] = (pdf[X] - pdf[X].mean()) / pdf[X].std(ddof=0)
    pdf["y"] = pdf["y"] - pdf["y"].mean()
    cols = np.column_stack([np.ones(len(pdf)), pdf[X], pdf["y"]])
    assert np.allclose(z.total, cols.T @ cols, atol=1e-8)


def test_vif_and_condition_number(moments, dense):
    z = moments.standardised()
    got = gram.vif(z)
    for j, c in enumerate(X):
        others = [x for x in X if x != c]
        w = np.column_stack([np.ones(len(dense)), dense[others]])
        e = dense[c] - w @ np.linalg.lstsq(w, dense[c], rcond=None)[0]
        r2 = 1 - (e**2).sum() / ((dense[c] - dense[c].mean()) ** 2).sum()
        assert got[c] == pytest.approx(1 / (1 - r2), rel=1e-9)
    std = np.column_stack([np.ones(len(dense)), (dense[X] - dense[X].mean()) / dense[X].std(ddof=0)])
    assert gram.condition_number(z) == pytest.approx(np.linalg.cond(std), rel=1e-9)


def test_vif_names_the_aliased_and_keeps_the_others(frame):
    alone = gram.vif(gram.moments(frame, ["a", "b"], "y").standardised())
    got = gram.vif(gram.moments(frame.selectExpr("*", "a * 3 + 1 as twin"), ["a", "b", "twin"], "y").standardised())
    assert math.isinf(got["a"]) and math.isinf(got["twin"])
    assert got["b"] == pytest.approx(alone["b"], rel=1e-9)


def test_a_search_that_does_not_settle_is_flagged(spark, frame):
    m = gram.moments(frame.selectExpr("*", "a + 1e-3 * b as near"), ["a", "b", "near"], "y", by="fold").standardised()
    short = models.Lasso(alphas=[1e-7], max_iter=2)
    with pytest.warns(UserWarning, match="did not settle"):
        short.fit(m, spark)
    full = models.Lasso(alphas=[1e-3])
    full.fit(gram.moments(frame, ["a", "b"], "y", by="fold").standardised(), spark)
    assert not short.converged and full.converged
    (row,) = full.convergence_table(spark).collect()
    assert row["converged"] and 0 < row["n_iter"] < 15000 and row["off_optimum"] < 1e-8


def test_registry():
    assert isinstance(models.create_model("  OLS "), models.OrdinaryLeastSquares)
    assert list(models.all_models()) == ["ols", "stepwise", "ridge", "lasso", "elasticnet"]
    with pytest.raises(ValueError, match="elasticnet"):
        models.create_model("forest")


def test_failing_model_is_kept_as_a_row(spark, frame, moments):
    class Broken(models.OrdinaryLeastSquares):
        key = "broken"

        def fit(self, m, spark):
            raise ArithmeticError("no")

    fitted, failed = evaluate.fit_tolerant([models.OrdinaryLeastSquares(), Broken()], moments, spark)
    assert [f.key for f in fitted] == ["ols"] and failed == {"broken": "ArithmeticError: no"}


def test_top_coefficients_list_each_feature_once(spark):
    coefs = spark.createDataFrame([("m", c, v) for c, v in zip("abcd", [3.0, -2.0, 1.0, 0.0])], "model string, feature string, coef double")
    both = models.top_coefficients(coefs, 15).collect()
    assert sorted(r["feature"] for r in both) == ["a", "b", "c"]
    size = models.top_coefficients(coefs, 2, by_abs=True).orderBy("rank").collect()
    assert [r["feature"] for r in size] == ["a", "b"]


def test_residual_tests_on_known_values(spark):
    e = np.array([1.0, -2.0, 0.5, 1.5, -1.0, 0.3])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "t int, resid double")
    dw = diagnostics.durbin_watson(df, ["t"]).first()["durbin_watson"]
    assert dw == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    d = e - e.mean()
    s, k = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2
    jb = diagnostics.jarque_bera(df).first()
    assert jb["jb"] == pytest.approx(len(e) / 6 * (s**2 + (k - 3) ** 2 / 4))


def test_tail_probabilities(spark):
    from loomstat.functions import tails

    assert tails.chi2_tail(7.8147279, 3) == pytest.approx(0.05, rel=1e-6)
    assert tails.f_tail(4.9646027, 1, 10) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_two_sided(2.2281389, 10) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_two_sided(60.0, 100) < 1e-70


def test_vif_of_a_thousand_columns_from_one_factorisation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 1000))
    x[:, 0] = x[:, 1] + 0.1 * x[:, 0]
    x[:, 7] = 2 * x[:, 8] - x[:, 9]  # one alias group of three
    m = gram.Moments([f"x{j}" for j in range(1000)], "y", {0: np.pad(x.T @ x, 1)})
    got = gram.vif(m)
    assert {f for f, v in got.items() if np.isinf(v)} == {"x7", "x8", "x9"}
    rest = np.delete(x, 9, axis=1)
    want = np.diag(rest.T @ rest) * np.diag(np.linalg.inv(rest.T @ rest))
    for j in (0, 1, 2, 500, 998):
        assert got[f"x{j + (j >= 9)}"] == pytest.approx(want[j], rel=1e-8)
