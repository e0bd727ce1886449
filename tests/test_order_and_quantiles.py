import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.operators import diagnostics, ordering, profile
from loomstat.operators.quantile import exact_quantiles


def series(n=3000, hot=True):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": np.arange(n), "t": rng.integers(0, n // 3, n), "s": rng.choice(["x", "y", "z"], n, p=[0.7, 0.2, 0.1])})
    if hot:
        pdf.loc[pdf.id % 3 == 0, "t"] = 5  # a third of all rows share one timestamp
    pdf["v"] = rng.normal(50, 9, n)
    pdf.loc[pdf.id % 7 == 0, "v"] = np.nan
    return pdf


@pytest.mark.parametrize("parts,chunk", [(1, 100000), (6, 100), (5, 37)])
def test_rolling_mean_equals_pandas(spark, parts, chunk):
    pdf = series()
    df = spark.createDataFrame(pdf).repartition(parts)
    got = ordering.rolling_mean(df, "v", ["t", "id"], rows=90, min_periods=20, chunk_rows=chunk).toPandas().sort_values(["t", "id"])
    want = pdf.sort_values(["t", "id"])["v"].rolling(90, min_periods=20).mean()
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["rolling_mean"].to_numpy(float), want.to_numpy(), rtol=1e-10)


def test_rolling_mean_by_series_equals_pandas(spark):
    pdf = series()
    got = ordering.rolling_mean(spark.createDataFrame(pdf), "v", ["t", "id"], rows=50, min_periods=10, by=["s"], chunk_rows=64)
    got = got.toPandas().set_index("id")["rolling_mean"].astype(float)
    want = pdf.sort_values(["s", "t", "id"]).set_index("id").groupby("s")["v"].rolling(50, min_periods=10).mean().droplevel(0)
    np.testing.assert_allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy(), rtol=1e-10)


def test_rolling_mean_treats_infinite_readings_as_missing(spark):
    df = spark.createDataFrame([(i, float("inf") if i == 2 else float(i)) for i in range(6)], "id int, v double")
    got = [r["rolling_mean"] for r in ordering.rolling_mean(df, "v", ["id"], rows=3, min_periods=1).orderBy("id").collect()]
    assert got == [0.0, 0.5, 0.5, 2.0, 3.5, 4.0]


def test_positions_are_consecutive(spark):
    pdf = series()
    got = ordering.numbered(spark.createDataFrame(pdf).repartition(7), ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert got[ordering.POSITION].tolist() == list(range(len(pdf)))


@pytest.mark.parametrize("n,k", [(53, 50), (7, 10), (1000, 50), (100, 7)])
def test_ntile_equals_sql(spark, n, k):
    df = spark.range(n)
    got = {r["id"]: r["tile"] for r in ordering.ntile(df, ["id"], k).collect()}
    df.createOrReplaceTempView("ids")
    want = {r["id"]: r["t"] for r in spark.sql(f"select id, ntile({k}) over (order by id) t from ids").collect()}
    assert got == want


def test_lag_crosses_chunks(spark):
    got = ordering.lagged(spark.range(1000).withColumnRenamed("id", "v"), "v", ["v"], chunk_rows=10)
    assert got.where("v > 0 and (lagged is null or lagged <> v - 1)").count() == 0
    assert got.where("lagged is null").count() == 1


@pytest.mark.parametrize("bins,direct", [(4096, 200_000), (8, 5), (3, 1)])
def test_quantiles_equal_numpy(spark, bins, direct):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "normal": rng.normal(size=4000), "heavy": rng.standard_cauchy(4000) * 1e6, "few": rng.integers(0, 4, 4000).astype(float),
        "third": np.where(np.arange(4000) % 3 == 0, 7.0, rng.normal(size=4000)), "gaps": rng.normal(size=4000), "none": np.nan, "one": np.nan,
    })
    pdf.loc[pdf.index % 5 == 0, "gaps"] = np.nan
    pdf.loc[17, "one"] = 3.5
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, list(pdf.columns), probs, bins=bins, direct_rows=direct)
    for c in pdf.columns:
        there = pdf[c].dropna()
        if there.empty:
            assert got[c] == [None] * len(probs)
        else:
            np.testing.assert_allclose(got[c], np.quantile(there, probs), rtol=1e-12, atol=1e-12)


def test_quantiles_with_infinities_and_extremes(spark):
    v = [float("-inf"), -1.7e308, -1.0, 0.0, 5e-324, 1.0, 1.7e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 2 / 7, 3 / 7, 1.0], bins=4, direct_rows=1)["v"]
    assert got[0] == float("-inf") and got[3] == float("inf")
    assert got[1] == pytest.approx(-1.0) and got[2] == pytest.approx(0.0)


def test_describe_handles_names_and_missing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None)], "`Cons. Específico  O2 EOP` double, `void x` double")
    rows = {r["variable"]: r for r in profile.describe(df).collect()}
    assert rows["Cons. Específico  O2 EOP"]["q50"] == 1.5 and rows["Cons. Específico  O2 EOP"]["count"] == 2
    assert rows["void x"]["count"] == 0 and rows["void x"]["max"] is None


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    rows = profile.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 2, 2, 2, 3]
    flat = profile.histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 4)
    assert flat.agg(F.sum("n")).first()[0] == 2


def test_kde_is_close_to_the_unbinned_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=1500)
    got = profile.kde(spark.createDataFrame(pd.DataFrame({"v": x})), "v").toPandas().sort_values("point")
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["density"], want, atol=1e-5)


def test_qq_points_of_normal_data_lie_on_the_diagonal(spark):
    e = np.random.default_rng(1).normal(size=20000)
    got = diagnostics.qq_points(spark.createDataFrame(pd.DataFrame({"resid": e})), points=19).toPandas()
    assert np.abs(got["sample"] - got["theoretical"]).max() < 0.05


@pytest.mark.parametrize("spike", [1e17, 1e300])
def test_rolling_mean_with_a_spike_is_local_and_the_same_for_every_chunk_size(spark, spike):
    df = spark.range(3000).selectExpr("id", "id % 3 as g", f"case when id = 10 then {spike!r} else 0.1 * (id % 7) end as x")
    for by in ([], ["g"]):
        runs = [{r.id: r.m for r in ordering.rolling_mean(df, "x", ["id"], rows=7, min_periods=1, by=by, output="m", chunk_rows=c).collect()}
                for c in (7, 500, 100_000)]
        assert runs[0] == runs[1] == runs[2]
        step = 3 if by else 1
        for i in range(0, 3000, 11):
            frame = [0.1 * (k % 7) if k != 10 else spike for k in range(i % step, i + 1, step)][-7:]
            assert runs[0][i] == pytest.approx(sum(frame) / len(frame), rel=1e-12)
