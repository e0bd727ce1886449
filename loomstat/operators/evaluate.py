"""Scores, comparison and choice of fitted models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import kernels
from loomstat.functions.exprs import adjusted_r2, format_params, q, rss_aic, rss_bic, sparsity_pct
from loomstat.operators.models import Regression, Weights
from loomstat.session import local_rows

RECORD_FIELDS = (
    "model_name", "train_mse", "train_rmse", "train_mae", "train_r2", "test_mse", "test_rmse", "test_mae", "test_r2",
    "adjusted_r2", "aic", "bic", "num_features_retained", "optimal_hyperparameters", "additional_diagnostics",
)


def _measures(y: Column, fitted: Column) -> list[Column]:
    e = y - fitted
    there = e.isNotNull()
    return [
        F.count(e).alias("n"),
        F.sum(e * e).alias("rss"),
        F.avg(F.abs(e)).alias("mae"),
        # the spread of y is taken over the rows that were scored
        (F.var_pop(F.when(there, y)) * F.count(e)).alias("tss"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    mse = F.col("rss") / F.col("n")
    return df.withColumns({
        "mse": mse,
        "rmse": F.sqrt(mse),
        "r2": F.when(F.col("tss") > 0, 1.0 - F.col("rss") / F.col("tss")),
    })


def regression_metrics(scored: DataFrame, by: Sequence[str] = ("model", "split"), label: str = "label",
                       fitted: str = "fitted") -> DataFrame:
    """``by, n, rss, tss, mse, rmse, mae, r2`` of rows that carry their model."""
    out = _finish(scored.groupBy(*by).agg(*_measures(q(label), q(fitted))))
    return out.select(*by, "n", "rss", "tss", "mse", "rmse", "mae", "r2")


def score_models(df: DataFrame, models: Sequence[Regression], label: str, split: str = "split") -> DataFrame:
    """The same measures for several models from one scan; rows are neither
    multiplied by model nor stored. Up to a few features predictions are
    expressions; above, batches are multiplied by the matrix of all models and
    every task leaves one row of sums per split and model."""
    w = Weights.of(models, df.columns)
    out = ("model", "split", "n", "rss", "tss", "mse", "rmse", "mae", "r2")
    if not w.wide:
        per_model = [F.struct(F.lit(m.key).alias("model"), *_measures(q(label), m.prediction(df.columns))) for m in models]
        rows = df.groupBy(q(split).alias("split")).agg(F.array(*per_model).alias("s")).select("split", F.inline("s"))
        return _finish(rows).select(*out)
    rows = df.select(q(split).alias("split"), q(label).cast("double").alias("y"), w.row().alias("x"))
    shift = float(np.mean(w.intercepts))  # near the label's mean, so that its spread keeps its digits
    partial = rows.mapInArrow(kernels.score_sums(w.weights, w.used, w.intercepts, shift),
                              "split string, at int, n bigint, rss double, sae double, sy double, syy double")
    sums = partial.groupBy("split", "at").agg(*[F.sum(c).alias(c) for c in ("n", "rss", "sae", "sy", "syy")])
    n = F.nullif(F.col("n"), F.lit(0))
    return _finish(sums.select(
        F.get(F.array(*[F.lit(m.key) for m in models]), F.col("at")).alias("model"), "split", "n",
        F.when(F.col("n") > 0, F.col("rss")).alias("rss"), (F.col("sae") / n).alias("mae"),
        F.greatest(F.col("syy") - F.col("sy") * F.col("sy") / n, F.lit(0.0)).alias("tss"),
    )).select(*out)


def _texts(values: Mapping[str, object]) -> dict[str, str]:
    return {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in values.items()}


def model_table(spark: SparkSession, models: Sequence[Regression],
                diagnostics: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """One row per fitted model: key, name, active features, parameters."""
    diagnostics = diagnostics or {}
    rows = [
        (m.key, m.name, len(m.selected()), list(_texts(m.parameters()).items()),
         [(k, None if v is None else float(v)) for k, v in diagnostics.get(m.key, {}).items()])
        for m in models
    ]
    return local_rows(
        spark, rows,
        "model string, model_name string, num_features_retained int, "
        "optimal_hyperparameters map<string,string>, additional_diagnostics map<string,double>",
    )


def model_records(metrics: DataFrame, models: DataFrame) -> DataFrame:
    """The 15-field record of each model. ``metrics`` holds a row per model and
    split, ``models`` a row per model."""
    measures = ("n", "rss", "mse", "rmse", "mae", "r2")
    sides = metrics.groupBy("model").agg(*[
        F.any_value(F.when(F.col("split") == s, F.col(c)), True).alias(f"{s}_{c}") for s in ("train", "test") for c in measures])
    k, n = F.col("num_features_retained"), F.col("train_n")
    return (
        models.join(sides, "model", "left")
        .withColumn("adjusted_r2", adjusted_r2(F.col("test_r2"), F.col("test_n"), k))
        .withColumn("aic", rss_aic(n, F.col("train_rss"), k))
        .withColumn("bic", rss_bic(n, F.col("train_rss"), k))
        .select("model", *RECORD_FIELDS)
    )


# The headings of the comparison table.
HEADINGS = {
    "model_name": "Modelo", "train_r2": "Train R2", "test_r2": "Test R2", "adjusted_r2": "Test R2 Adj", "test_rmse": "Test RMSE (kg/ADt)",
    "test_mae": "Test MAE (kg/ADt)", "aic": "AIC", "bic": "BIC", "num_features_retained": "N Variables",
    "params": "Hiperparametros / Regularizacion",
}


def comparison_table(records: DataFrame) -> DataFrame:
    """Ten columns, best test R2 first, models without a score last."""
    shown = {
        "aic": F.coalesce("aic", F.lit(float("nan"))), "bic": F.coalesce("bic", F.lit(float("nan"))),
        "params": format_params(F.col("optimal_hyperparameters")),
    }
    return records.select(*[shown.get(c, F.col(c)).alias(h) for c, h in HEADINGS.items()]).orderBy(F.desc_nulls_last(HEADINGS["test_r2"]))


def chart_rows(records: DataFrame) -> DataFrame:
    """What a comparison chart shows: score, error and size of each model."""
    return records.select("model_name", "test_r2", "test_rmse", "num_features_retained")


def select_best(records: DataFrame, tolerance: float = 0.0015) -> DataFrame:
    """Of the models less than ``tolerance`` below the best test R2, the one
    with fewest features; the higher R2 on a tie."""
    best = records.agg(F.max("test_r2")).first()[0]
    if best is None:
        raise ValueError("no evaluated models")
    close = records.where(F.lit(best) - F.col("test_r2") < tolerance)
    return close.orderBy("num_features_retained", F.desc("test_r2")).limit(1)


def select_highest(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc_nulls_last("test_r2")).limit(1)


def active_features(coefs: DataFrame) -> DataFrame:
    """Non-zero coefficients, total and sparsity per model."""
    counts = coefs.groupBy("model").agg(F.count_if(F.col("coef") != 0).alias("n_active"), F.count("*").alias("n_total"))
    return counts.withColumn("sparsity_pct", sparsity_pct(F.col("n_active"), F.col("n_total")))


def fit_tolerant(models: Sequence[Regression], m, spark: SparkSession) -> tuple[list[Regression], dict[str, str]]:
    """Fit all; a model that its data does not allow is reported instead of
    ending the run. Failures of Spark itself are not the model's, and rise."""
    fitted, failed = [], {}
    for model in models:
        try:
            fitted.append(model.fit(m, spark))
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            failed[model.key] = f"{type(e).__name__}: {e}"
    return fitted, failed


def with_failures(records: DataFrame, failed: Mapping[str, str], names: Mapping[str, str] | None = None) -> DataFrame:
    """Append a row of null measures, and the reason, per failed model."""
    names = names or {}
    rows = [(k, names.get(k, k), why) for k, why in failed.items()]
    lost = local_rows(records.sparkSession, rows, "model string, model_name string, error string")
    return records.withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def report_facts(records: DataFrame, best: DataFrame, kpis: DataFrame, settings) -> DataFrame:
    """The figures of an executive summary as ``(section, key, value)``."""
    def facts(df: DataFrame, section: str, pairs: Sequence[tuple[Column | str, Column]]) -> DataFrame:
        rows = F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), v.alias("value")) for k, v in pairs])
        return df.select(F.lit(section).alias("section"), F.inline(rows))

    num = lambda c, d: F.format_string(f"%.{d}f", F.col(c))
    context = [
        ("design_limit", F.format_string("%.2f", F.lit(settings.design_limit))),
        ("observed_mean", num("mean", 2)), ("observed_max", num("max", 2)), ("share_over_limit", num("share_over", 4)),
        ("historical_mean", F.format_string("%.2f", F.lit(settings.historical_mean))),
        ("historical_max", F.format_string("%.2f", F.lit(settings.historical_max))),
        ("annual_savings_usd", F.format_string("%.0f", F.lit(settings.annual_savings_usd))),
        ("benefit_30pct_usd", F.format_string("%.0f", F.lit(settings.benefit_30pct_usd))),
    ]
    table = [
        (F.concat(F.col("model"), F.lit(".test_r2")), num("test_r2", 4)),
        (F.concat(F.col("model"), F.lit(".test_rmse")), num("test_rmse", 4)),
        (F.concat(F.col("model"), F.lit(".n_features")), F.col("num_features_retained").cast("string")),
    ]
    winner = [
        ("model", F.col("model_name")), ("test_r2", num("test_r2", 4)), ("test_rmse", num("test_rmse", 4)),
        ("test_mae", num("test_mae", 4)), ("n_features", F.col("num_features_retained").cast("string")),
    ]
    diag = records.select(F.lit("diagnostics").alias("section"), "model", F.explode("additional_diagnostics").alias("k", "v")).select(
        "section", F.concat_ws(".", "model", "k").alias("key"), F.format_string("%.4f", F.col("v")).alias("value")
    )
    return (
        facts(kpis, "context", context)
        .unionByName(facts(records, "comparison", table))
        .unionByName(diag)
        .unionByName(facts(best, "winner", winner))
    )
