"""Paths that matter on wide tables and long series: their plans, and their results against numpy."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.operators import clean, evaluate, gram, iterative, models, ordering, split


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- wide scoring


def wide_models(p, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k, name in enumerate(("one", "two", "three")):
        m = models.OrdinaryLeastSquares(name)
        m.key, m.intercept = name, float(10 + k)
        m.coefs = {f"x{j}": float(rng.normal()) for j in range(0, p, k + 1)}
        out.append(m)
    return out


def wide_table(spark, p, n=400, gaps=False):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, p))
    if gaps:
        x[::7, 1] = np.nan
    y = 1e6 + x[:, 0] + rng.normal(size=n)
    arrays = [pa.array(x[:, j], from_pandas=True) for j in range(p)]
    parts = pa.array(["train" if k % 4 else "test" for k in range(n)])
    df = spark.createDataFrame(pa.Table.from_arrays([*arrays, pa.array(y), parts], names=[*[f"x{j}" for j in range(p)], "y", "split"]))
    return df, x, y


def by_hand(m, x):
    at = [int(f[1:]) for f in m.coefs if int(f[1:]) < x.shape[1]]
    return m.intercept + x[:, at] @ np.array([m.coefs[f"x{j}"] for j in at])


@pytest.mark.parametrize("p,gaps", [(5, True), (12, True), (1000, False)])
def test_predictions_and_scores_of_several_models_equal_numpy(spark, p, gaps):
    df, x, y = wide_table(spark, p, gaps=gaps)
    fitted = wide_models(p + 3)  # three features that the table lacks count as zero
    for m in fitted:
        m.intercept += 1e6
    got = models.predictions(df, fitted, [m.key for m in fitted]).select("y", *[m.key for m in fitted]).toPandas().sort_values("y")
    order = np.argsort(y)
    want = {m.key: by_hand(m, x) for m in fitted}
    for m in fitted:
        np.testing.assert_allclose(got[m.key].to_numpy(float), want[m.key][order], rtol=1e-12)
    scores = {(r.model, r.split): r for r in evaluate.score_models(df, fitted, "y").collect()}
    assert len(scores) == 6
    for (name, part), r in scores.items():
        mine = np.array([(k % 4 > 0) == (part == "train") for k in range(len(y))]) & ~np.isnan(want[name])
        e = (y - want[name])[mine]
        assert r.n == mine.sum()
        assert r.rss == pytest.approx((e * e).sum(), rel=1e-9) and r.mae == pytest.approx(np.abs(e).mean(), rel=1e-9)
        assert r.tss == pytest.approx(((y[mine] - y[mine].mean()) ** 2).sum(), rel=1e-7)


def test_wide_tables_use_the_matrix_and_narrow_ones_expressions(spark):
    for p, wide in ((5, False), (12, True)):
        df, _, _ = wide_table(spark, p, 8)
        fitted = wide_models(p)
        assert ("MapInArrow" in plan_of(evaluate.score_models(df, fitted, "y"))) == wide
        assert ("ArrowEvalPython" in plan_of(models.predictions(df, fitted, list("abc")))) == wide
    rows = fitted[0].residuals(df, "y")
    assert rows.columns[-2:] == ["fitted", "resid"] and rows.count() == 8


# ---------------------------------------------------------------- wide cross products


@pytest.mark.parametrize("p,cells", [(12, 30), (12, 1), (40, 1 << 20)])
def test_blocked_cross_products_equal_numpy(spark, p, cells):
    df, x, y = wide_table(spark, p, 200, gaps=True)
    df = df.withColumn("fold", (F.monotonically_increasing_id() % 3).cast("int"))
    pdf = df.toPandas()
    cols = [f"x{j}" for j in range(p)]
    z = np.column_stack([np.ones(200), pdf[cols].to_numpy(float)])
    there = ~np.isnan(z).any(axis=1)
    got = gram.gram_rows(df, cols, "fold", narrow=4, cells=cells).toPandas()
    for g in range(3):
        mine = z[there & (pdf.fold == g).to_numpy()]
        m = np.zeros((p + 1, p + 1))
        part = got[got.grp == g]
        m[part.i, part.j] = part.value
        np.testing.assert_allclose(m, np.triu(mine.T @ mine), rtol=1e-10, atol=1e-9)
    r = gram.corr_matrix(df, cols, cells=cells).toPandas()
    want = pdf[cols].corr()
    assert len(r) == p * (p - 1) // 2 and (r.i < r.j).all()
    np.testing.assert_allclose(r.r, [want.loc[a, b] for a, b in zip(r.col_i, r.col_j)], atol=1e-10)
    assert (r.n == [(pdf[a].notna() & pdf[b].notna()).sum() for a, b in zip(r.col_i, r.col_j)]).all()


def test_a_thousand_columns_stay_within_the_blocks(spark):
    """Per task: one block of sums, and lists of bounded length; the whole matrix is in no task, row or plan."""
    p, cells = 1000, 60_000
    df, x, _ = wide_table(spark, p, 300)
    blocks = gram.row_blocks(p + 1, cells)
    assert max((b - a) * (p + 1 - a) for a, b in blocks) <= cells and blocks[-1][1] == p + 1 and len(blocks) > 8
    rows = gram.gram_rows(df, [f"x{j}" for j in range(p)], cells=cells)
    logical = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(logical) < 400 * p  # one mention of a column per block at most, nothing per pair
    got = rows.where("i % 97 = 3").toPandas()
    z = np.column_stack([np.ones(300), x])
    np.testing.assert_allclose(got.value, [z[:, i] @ z[:, j] for i, j in zip(got.i, got.j)], rtol=1e-9, atol=1e-9)
    assert rows.count() == (p + 1) * (p + 2) // 2


# ---------------------------------------------------------------- without a matrix


def test_conjugate_gradients_equal_the_direct_solution(spark, dense):
    pdf = dense.assign(copy=dense["a"] * 3 - 2, flat=4.0, far=1e7 + dense["d"])
    features = ["a", "b", "c", "far", "copy", "flat"]
    df = spark.createDataFrame(pdf.assign(c=pdf["c"].where(pdf.index % 9 > 0)))
    rows = pdf[pdf.index % 9 > 0]
    x = rows[features].to_numpy(float)
    std = x.std(axis=0)
    std[std < 1e-12] = np.inf
    z, y = (x - x.mean(axis=0)) / std, rows["y"] - rows["y"].mean()
    alphas = [0.0, 1.0, 250.0]
    got = iterative.conjugate_gradient(df, features, "y", alphas)
    assert got.converged and got.passes < 20
    for a, b, b0 in zip(alphas, got.coefs, got.intercepts):
        w, v = np.linalg.eigh(z.T @ z)  # collinear columns share their effect
        want = v @ np.where(w + a > 1e-8, (v.T @ (z.T @ y)) / np.where(w + a > 1e-8, w + a, 1), 0) / std
        np.testing.assert_allclose(b, want, rtol=1e-8, atol=1e-10)
        assert b0 == pytest.approx(rows["y"].mean() - x.mean(axis=0) @ want, rel=1e-8)
    direct = models.OrdinaryLeastSquares().fit(gram.moments(df.select("a", "b", "c", "y"), ["a", "b", "c"], "y"), spark)
    fit = iterative.IterativeLeastSquares().fit_rows(df, ["a", "b", "c"], "y")
    assert fit.coefs == pytest.approx(direct.coefs, rel=1e-8) and fit.intercept == pytest.approx(direct.intercept, rel=1e-8)
    assert fit.predict(df).where("fitted is null").count() == (pdf.index % 9 == 0).sum()


def test_conjugate_gradients_on_more_features_than_rows_and_on_nothing(spark):
    df, x, y = wide_table(spark, 30, 12)
    fit = iterative.IterativeLeastSquares().fit_rows(df, [f"x{j}" for j in range(30)], "y")
    score = evaluate.score_models(df, [fit], "y").agg(F.sum("rss")).first()[0]
    assert score < 1e-10 * ((y - y.mean()) ** 2).sum()  # the rows can be met exactly
    with pytest.raises(ValueError):
        iterative.conjugate_gradient(df.limit(0), ["x0"], "y")
    with pytest.warns(UserWarning, match="ended after"):
        assert not iterative.conjugate_gradient(df, [f"x{j}" for j in range(30)], "y", max_passes=4).converged


def constraints_in_scale(monkeypatch) -> list[int]:
    """To be filled with the number of constraints that the optimizer derives for what the scale is fitted on."""
    seen = []

    def watched(df, cols):
        seen.append(df._jdf.queryExecution().optimizedPlan().validConstraints().size())
        return clean.fit_scale(df, cols)

    monkeypatch.setattr(iterative, "fit_scale", watched)
    return seen


def computed_columns(spark, path, p, n=300):
    """A stored table with gaps whose features are standardised by expressions, as ``prepare`` leaves them."""
    df, x, y = wide_table(spark, p, n, gaps=True)
    df.write.parquet(path)
    names = [f"x{j}" for j in range(p)]
    return clean.standardise(spark.read.parquet(path), {c: (0.25, 2.0) for c in names}), names, (x - 0.25) / 2.0, y


def test_least_squares_by_passes_plan_no_subsets_of_computed_columns(spark, tmp_path, monkeypatch):
    seen = constraints_in_scale(monkeypatch)
    df, names, x, y = computed_columns(spark, str(tmp_path / "rows"), 5)
    fit = iterative.IterativeLeastSquares().fit_rows(df, names, "y")
    assert len(seen) == 1 and seen[0] <= len(names) + 1  # one condition on all columns made 2^5 of itself and more
    there = ~np.isnan(x).any(axis=1)
    assert 0 < there.sum() < len(y)
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(there.sum()), x[there]]), y[there], rcond=None)
    assert [fit.intercept, *fit.coefs.values()] == pytest.approx(want, rel=1e-8)


def test_ridge_by_passes_plans_no_subsets_of_computed_columns(spark, tmp_path, monkeypatch):
    seen = constraints_in_scale(monkeypatch)
    df, names, x, y = computed_columns(spark, str(tmp_path / "rows"), 13)
    alphas = [1.0, 100.0, 10_000.0]
    got = iterative.conjugate_gradient(df, names, "y", alphas)
    assert len(seen) == 1 and seen[0] <= len(names) + 1
    there = ~np.isnan(x).any(axis=1)
    x, y = x[there], y[there]
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / std
    for a, b, b0 in zip(alphas, got.coefs, got.intercepts):
        want = np.linalg.solve(z.T @ z + a * np.eye(len(names)), z.T @ (y - y.mean())) / std
        np.testing.assert_allclose(b, want, rtol=1e-8, atol=1e-10)
        assert b0 == pytest.approx(y.mean() - x.mean(axis=0) @ want, rel=1e-8)
    with pytest.raises(ValueError, match="no complete rows"):
        iterative.conjugate_gradient(df.withColumn("x1", F.lit(None).cast("double")), names, "y", alphas)


# ---------------------------------------------------------------- long series


def test_ordered_operators_exchange_rows_once_and_store_nothing(spark, tmp_path):
    df = spark.range(0, 5000, 1, 6).selectExpr("(id * 7919) % 5000 as t", "cast(id as double) as v")
    rolling = ordering.rolling_mean(df, "v", ["t"], rows=50, min_periods=5, chunk_rows=200)
    lagged = ordering.lagged(df, "v", ["t"], chunk_rows=200)
    for out in (rolling, lagged, ordering.ntile(df, ["t"], 7)):
        plan = plan_of(out)
        assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan
    sizes = ordering.chunked(df, ["t"], 49, 200).groupBy("_chunk").agg(F.count("*").alias("n"), F.sum(F.col("_real").cast("int")).alias("own")).collect()
    assert len(sizes) >= 15 and sum(r.own for r in sizes) == 5000 and max(r.n for r in sizes) < 1000


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "string", "decimal(12,3)", "boolean", "float", "int"])
def test_keys_of_any_type_are_numbered_in_their_order(spark, kind):
    rng = np.random.default_rng(9)
    base = spark.createDataFrame(pd.DataFrame({"a": rng.integers(0, 40, 3000), "b": rng.permutation(3000)}))
    how = {"date": "date_add(date'1969-12-20', cast(a as int))", "timestamp": "timestamp_seconds(a * 0.5 - 9)",
           "timestamp_ntz": "cast(timestamp_seconds(a * 0.5 - 9) as timestamp_ntz)", "boolean": "a % 2 = 0"}.get(kind, f"cast(a - 20 as {kind})")
    df = base.selectExpr(f"case when a <> 5 then {how} end as k", "b")
    got = ordering.numbered(df, ["k", "b"], chunk_rows=100).orderBy("_position").collect()
    want = df.orderBy("k", "b").collect()
    assert [(r.k, r.b, r._position) for r in got] == [(r.k, r.b, i) for i, r in enumerate(want)]


def test_equal_and_extreme_keys_stay_in_order(spark):
    values = [float("-inf"), -0.0, 0.0, 1.5, float("inf"), float("nan"), None] * 300
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int")
    got = [r._position for r in ordering.numbered(df, ["v", "i"], chunk_rows=50).orderBy("v", "i").collect()]
    assert got == list(range(len(values)))
    assert ordering.numbered(df.limit(0), ["v", "i"]).count() == 0


# ---------------------------------------------------------------- exact split


@pytest.mark.parametrize("n,ratio,direct", [(1000, 0.2, 10_000), (1000, 0.2, 3), (997, 0.333, 3), (5, 0.2, 1), (10, 1.0, 1), (10, 0.0, 1)])
def test_exact_split_takes_the_first_hashes_without_moving_rows(spark, n, ratio, direct):
    df = spark.range(n).selectExpr("cast(id as string) as key")
    out = split.exact_split(df, "key", ratio, direct_rows=direct)
    assert "Exchange" not in plan_of(out)
    got = {r.key for r in out.where("split = 'test'").collect()}
    order = [r.key for r in df.orderBy(F.md5(F.concat(F.lit("2022:"), "key")), "key").collect()]
    assert got == set(order[: math.ceil(round(ratio * n, 9))])


@pytest.mark.parametrize("ratio", [0.1, 0.3, 0.5, 0.8])
def test_exact_split_with_hot_and_missing_keys(spark, ratio):
    df = spark.range(0, 900, 1, 5).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else cast(id as string) end as key", "id")
    for tie in ((), ("id",)):
        out = split.exact_split(df, "key", ratio, tie_break=tie, direct_rows=10)
        assert out.count() == 900 and out.where("split = 'test'").count() == math.ceil(round(ratio * 900, 9))
    assert split.exact_split(df.limit(0), "key").count() == 0


def test_evenly_spread_keys_are_cut_without_bounds(spark):
    df = spark.createDataFrame([(float(i % 997), i) for i in range(20_000)] + [(None, -1), (float("nan"), -2), (float("inf"), -3), (float("-inf"), -4)], "v double, i int")
    even = ordering.cut_order(df, ["v", "i"], 500)
    assert not even.bounds and sum(even.sizes) == 20_004 and max(even.sizes) <= 4 * 20_004 / (len(even.sizes) - 1)
    got = [r._position for r in ordering.numbered(df, ["v", "i"], chunk_rows=500).orderBy("v", "i").collect()]
    assert got == list(range(20_004))
    hot = df.withColumn("v", F.when(F.col("i") % 3 > 0, 5.0).otherwise(F.col("v")))
    assert ordering.cut_order(hot, ["v", "i"], 500).bounds  # one value of two thirds: bounds over all keys


def test_tiles_move_only_the_cells_in_which_one_ends(spark, monkeypatch):
    monkeypatch.setattr(ordering, "cut_order", lambda df, by, cut=ordering.cut_order: cut(df, by, 500))
    # rows that are equal in all keys lie across the ends of tiles
    df = spark.range(20_000).selectExpr("cast(id div 3 as double) as v", "id % 2 as k")
    out = ordering.ntile(df, ["v", "k"], 7)
    sizes = {r["tile"]: r["count"] for r in out.groupBy("tile").count().collect()}
    assert sizes == {t: 2858 if t <= 20_000 % 7 else 2857 for t in range(1, 8)}
    ends = out.groupBy("tile").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("tile").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:]))
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_sorted_once_know_their_places(spark, tmp_path):
    df = spark.range(5_000).selectExpr("id", "case when id % 5 > 0 then id % 3 end as t", "cast(id % 11 as double) as v").repartition(6)
    ordering.sorted_rows(df, ["t", "id"], 300).write.parquet(str(tmp_path / "sorted"))
    rows = ordering.placed(spark.read.parquet(str(tmp_path / "sorted")))
    got = [r["_place"] for r in rows.orderBy("t", "id").collect()]
    assert got == list(range(5_000))
    by_place = ordering.rolling_mean(rows, "v", ["_place"], 50, 5, chunk_rows=200, places=True).drop("_place")
    by_keys = ordering.rolling_mean(df, "v", ["t", "id"], 50, 5, chunk_rows=200)
    assert {tuple(r) for r in by_place.select(*by_keys.columns).collect()} == {tuple(r) for r in by_keys.collect()}
    # the end of a block is summed backwards: no frame is opened anew for each of its rows
    assert "unboundedfollowing" not in by_place._jdf.queryExecution().optimizedPlan().toString().lower()


def test_column_sums_are_the_same_side_by_side_and_by_value(spark, monkeypatch):
    from loomstat.operators import quantile

    df = spark.createDataFrame([(i % 2, float(i), None if i % 3 else float("nan"), None if i % 4 else i) for i in range(40)], "g int, a double, b double, c int")
    sums = lambda: {tuple(r) for r in quantile.column_sums(df, ["a", "b", "c"], lambda v: [F.min(v), F.max(v), F.avg(v)], ["g"]).collect()}
    side = sums()
    monkeypatch.setattr(quantile, "SIDE_BY_SIDE", 0)
    assert side == sums() and {r[1] for r in side} == {0, 2}
    assert quantile.column_sums(df, [], lambda v: [F.min(v)]).count() == 0
