import json
import math
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomstat.config import Settings
from loomstat.operators import evaluate, models, profile
from loomstat.operators.clean import clean_types
from loomstat.sources import landing

# Published scores of the five models on the plant data: (name, test R2, features).
PUBLISHED = [
    ("ols", 0.997436, 87), ("stepwise", 0.997094, 25), ("ridge", 0.997436 - 2e-7, 87), ("lasso", 0.997248, 61), ("elasticnet", 0.997248, 61),
]


def records(spark, rows=PUBLISHED):
    return spark.createDataFrame([(n, n, r, k) for n, r, k in rows], "model string, model_name string, test_r2 double, num_features_retained int")


def test_parsimonious_choice(spark):
    assert evaluate.select_best(records(spark)).first()["model"] == "stepwise"
    assert evaluate.select_best(records(spark), 0.0001).first()["model"] == "ols"
    assert evaluate.select_highest(records(spark)).first()["model"] == "ols"
    with pytest.raises(ValueError):
        evaluate.select_best(records(spark).where("false"))


def test_published_criteria_follow_from_the_formulas():
    n, k = 16_100, 87
    assert math.log(n) == pytest.approx((-91717.8021 - -92394.2207) / (k + 1) + 2, abs=1e-4)
    assert -46704.3999 - -92394.2207 == pytest.approx(n * (math.log(2 * math.pi) + 1), rel=1e-6)
    assert 3007.5576 / n == pytest.approx(0.1868, abs=1e-4)
    from loomstat.functions.exprs import log_grid_values

    assert log_grid_values(-4, 4, 60)[24] == pytest.approx(0.179571, rel=1e-5)
    assert models.loglik_aic(n, 51.25805, k) == pytest.approx(-46704.4, rel=1e-4)


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, split string, label double, fitted double")


def test_metrics_edges(spark):
    rows = [("m", "train", float(i), float(i)) for i in range(5)] + [("m", "test", 1.0, 2.0), ("m", "test", 3.0, 2.0), ("m", "test", None, 1.0)]
    got = {r["split"]: r for r in evaluate.regression_metrics(scored(spark, rows)).collect()}
    assert got["train"]["rss"] == 0 and got["train"]["r2"] == 1
    assert got["test"]["n"] == 2 and got["test"]["mse"] == 1 and got["test"]["r2"] == 0
    table = spark.createDataFrame([("m", "M", 3, {"a": "1"}, {"d": 1.0})],
                                  "model string, model_name string, num_features_retained int, optimal_hyperparameters map<string,string>, additional_diagnostics map<string,double>")
    rec = evaluate.model_records(evaluate.regression_metrics(scored(spark, rows)), table).first()
    assert rec["aic"] is None and rec["bic"] is None  # a perfect fit has no criterion
    assert rec["adjusted_r2"] == rec["test_r2"]  # too few rows to adjust


def test_comparison_puts_failures_last_and_formats_parameters(spark):
    df = spark.createDataFrame(
        [("A", 0.5, {"lambda_optimo": "0.179571", "cv_folds": "5", "variables_seleccionadas": "x,y"}), ("B", None, None), ("C", 0.9, {})],
        "model_name string, test_r2 double, optimal_hyperparameters map<string,string>",
    )
    for c in ("train_r2", "adjusted_r2", "test_rmse", "test_mae", "aic", "bic"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    out = evaluate.comparison_table(df.withColumn("num_features_retained", F.lit(1))).collect()
    assert [r["Modelo"] for r in out] == ["C", "A", "B"]
    assert out[1]["Hiperparametros / Regularizacion"] == "cv_folds=5, lambda_optimo=0.1796"
    assert out[0]["Hiperparametros / Regularizacion"] == "N/A" and math.isnan(out[0]["AIC"])


def test_grid_expression_equals_its_values(spark):
    from loomstat.functions.exprs import log_grid, log_grid_values

    got = spark.range(1).select(log_grid(-3, 3, 50).alias("g")).first()["g"]
    assert got == pytest.approx(log_grid_values(-3, 3, 50), rel=1e-14)
    assert log_grid_values(2, 9, 1) == [100.0]


def test_report_facts(spark):
    df = records(spark).selectExpr("*", "0.1D as test_rmse", "0.05D as test_mae", "map('jb', 1.5D) as additional_diagnostics")
    kpis = profile.target_kpis(spark.createDataFrame([(17.0,), (18.0,)], "v double"), "v", 17.5)
    facts = {(r["section"], r["key"]): r["value"] for r in evaluate.report_facts(df, evaluate.select_best(df), kpis, Settings()).collect()}
    assert facts["winner", "model"] == "stepwise" and facts["context", "share_over_limit"] == "0.5000"
    assert facts["comparison", "ols.n_features"] == "87" and facts["diagnostics", "ols.jb"] == "1.5000"


TIERED = """Unnamed: 2,Flujo. x,Nivel á
,CE05_A,
,kg/s,%
2019-04-01 00:04:00,2.5,abc
2019-04-01 00:02:00,1.5,7
"""


def test_tiered_export_and_cache(spark):
    home = Path(tempfile.mkdtemp(prefix="loomstat-landing-"))
    (home / "export.csv").write_text(TIERED, encoding="utf-8")
    sources = [str(home / "absent.csv"), str(home / "export.csv")]
    data, meta = landing.load_export(spark, sources, str(home / "cache"))
    assert [tuple(r)[1:] for r in data.orderBy("Timestamp").collect()] == [(1.5, 7.0), (2.5, None)]
    tags = {r["variable"]: (r["tag"], r["unit"]) for r in meta.collect()}
    assert tags["Flujo. x"] == ("CE05_A", "kg/s") and tags["Nivel á"] == ("N/A", "%")
    (home / "export.csv").write_text(TIERED.replace("2.5", "9.5"), encoding="utf-8")
    cached, meta = landing.load_export(spark, sources, str(home / "cache"))
    assert cached.agg(F.max(F.col("`Flujo. x`"))).first()[0] == 2.5 and meta.count() == 3
    fresh, _ = landing.load_export(spark, sources, str(home / "cache"), use_cache=False)
    assert fresh.agg(F.max(F.col("`Flujo. x`"))).first()[0] == 9.5
    with pytest.raises(FileNotFoundError):
        landing.load_export(spark, sources[:1], str(home / "cache"))


def test_tiers_are_told_by_place_in_every_file(spark):
    home = Path(tempfile.mkdtemp(prefix="loomstat-landing-"))
    (home / "a.csv").write_text("t,x,y\n,TAG,\n,,\n1,2,3\n,,\n,TAG,\n", encoding="utf-8")
    (home / "b.csv").write_text("t,x,y\n,OTHER,Q\n,kg,%\n4,5,6\n,,\n", encoding="utf-8")
    data, meta = landing.read_tiered_csv(spark, str(home))
    assert sorted(map(tuple, data.collect()), key=str) == sorted(
        [("1", "2", "3"), (None, None, None), (None, "TAG", None), ("4", "5", "6"), (None, None, None)], key=str)
    assert {tuple(r) for r in meta.collect()} == {("t", "N/A", "N/A"), ("x", "TAG", "N/A"), ("y", "N/A", "N/A")}


def test_header_split_by_row_number(spark):
    df = spark.createDataFrame([(0, "T1", None), (1, "kg", "%"), (2, "1", "x"), (3, "2", "3")], "row_idx int, `a.b` string, c string")
    data, meta = landing.split_header(df, "row_idx")
    assert data.count() == 2 and data.columns == ["a.b", "c"]
    assert {tuple(r) for r in meta.collect()} == {("a.b", "T1", "kg"), ("c", "N/A", "%")}
    assert clean_types(data.withColumn("t", F.lit("2020-01-01")), "t").columns == ["Timestamp", "a.b", "c"]


def test_json_keeps_absent_values(spark):
    path = tempfile.mkdtemp(prefix="loomstat-json-") + "/out"
    df = spark.createDataFrame([("m", None, {"k": "v"})], "model_name string, aic double, optimal_hyperparameters map<string,string>")
    landing.export_json(df, path)
    lines = [json.loads(line) for f in Path(path).glob("part-*") for line in f.read_text().splitlines()]
    assert lines == [{"model_name": "m", "aic": None, "optimal_hyperparameters": {"k": "v"}}]


def test_quarantine_parts_readings_from_cells_that_hold_none(spark, tmp_path):
    from loomstat.sources import landing

    rows = [(1, "2.5", " 7 ", "x"), (2, "abc", None, "y"), (3, "NaN", "1,5", "z"), (4, None, "", "w"), (5, "1e3", "-0", "v")]
    df = spark.createDataFrame(rows, "line int, a string, `b c` string, extra string")
    typed, rejected, seen = landing.quarantine(df, ["a", "b c"], ["line"], str(tmp_path / "q"))
    assert {(r.line, r.a, r["b c"]) for r in typed.collect()} == {(1, 2.5, 7.0), (2, None, None), (3, None, None), (4, None, None), (5, 1000.0, 0.0)}
    want = {(2, "a", "abc", "unreadable"), (3, "a", "NaN", "not a number"), (3, "b c", "1,5", "unreadable"), (4, "b c", "", "unreadable")}
    assert {tuple(r) for r in rejected.collect()} == want and seen == {"rows": 5, "rejected": 4}
    nothing = landing.quarantine(df.limit(0), ["a"], ["line"], str(tmp_path / "none"))
    assert nothing[0].count() == nothing[1].count() == 0 and nothing[2] == {"rows": 0, "rejected": 0}
