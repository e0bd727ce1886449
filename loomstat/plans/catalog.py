"""Named queries over the star-schema tables, one or more per operator.

Every query runs over whole tables. Sums of large values are put on a relative
scale before rounding, so that two engines summing in different orders agree.
Values of single rows are shown to two decimals, where engines that differ by
1e-10 practically never fall on two sides of an edge; their relative sums
(``metrics``, ``jarque_bera``) are shown with all digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.config import Settings
from loomstat.functions.exprs import format_params, literal_array, log_grid_values, q, rounded
from loomstat.operators import clean, diagnostics, domain, evaluate, gram, iterative, models, ordering, profile, split
from loomstat.plans.regression import Prepared, default_suite, feature_roles, least_squares_checks, local_copy, prepare, run, stage
from loomstat.session import local_rows, scratch_path
from loomstat.sources import landing, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE = Settings(target="charge", leakage=("disc_price",), disabled=("price_copy",), design_limit=17.5)
WIDE = Settings(target="charge", leakage=("disc_price",), disabled=(), design_limit=50_000.0)
FEATURES = ["price", "discount", "tax", "qty"]
ORDER = ["ts", "key"]
COMPARED = ["model", "train_r2", "test_r2", "test_r2_adj", "test_rmse", "test_mae", "aic", "bic", "n_features", "params"]
COMPARED_DIGITS = {"train_r2": 8, "test_r2": 8, "test_r2_adj": 8, "test_rmse": 4, "test_mae": 4, "aic": 2, "bic": 2}
SHRUNK = {"weak": 0.5, "middle": 1000.0, "strong": 5000.0}
SPIKE = 1e17
SENSORS = ["Flujo CLO2 Etapa D0", "Cons. Específico  O2 EOP", "Nivel Etapa D1"]
PLAIN = ["flujo", "cons", "nivel"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shown(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns of a result."""
    return df.withColumns({c: rounded(q(c), d) for c, d in digits.items()})


def line_prepared(spark: SparkSession, sf: str) -> Prepared:
    return prepare(tables.line_table(spark, sf), LINE, "key", ["ts"])


def line_ols(spark: SparkSession, sf: str) -> tuple[Prepared, gram.Moments, models.Regression]:
    p = line_prepared(spark, sf)
    m = p.moments()
    return p, m, models.OrdinaryLeastSquares().fit(m, spark)


def line_residuals(spark: SparkSession, sf: str) -> DataFrame:
    p, _, ols = line_ols(spark, sf)
    return ols.residuals(p.train, p.label)


# ---------------------------------------------------------------- sources


@query
def read_profile(spark, sf):
    return profile.schema_inventory(tables.feature_table(spark, sf))


@query
def preview(spark, sf):
    return profile.preview(tables.line_table(spark, sf).select("key", "ts", "charge"), ORDER)


@query
def csv_landing(spark, sf):
    path = landing.write_csv(tables.raw_export(spark, sf), scratch_path(spark, "landing"))
    found = landing.resolve_path(spark, [f"{path}-absent", path])
    data, _ = landing.split_header(landing.read_landed(spark, found), "row_idx")
    typed = clean.require_time_axis(clean.clean_types(data, "Unnamed: 2", ["Unnamed: 0", "Unnamed: 1"]), "Timestamp")
    return typed.orderBy("Timestamp").toDF("ts", *PLAIN)


EXPORT_FILES = 8


def write_tiered(spark, sf) -> str:
    """All events as an export of several files, each with its own tags and
    units; every file's units differ, file 0 has none, and some rows are empty."""
    raw = tables.raw_export(spark, sf).where("row_idx >= 2")
    cols = ["Unnamed: 2", *SENSORS]
    empty = F.col("row_idx") % 31 == 0
    file = F.pmod(F.col("row_idx"), F.lit(EXPORT_FILES)).cast("int")
    cells = F.struct(*[F.when(~empty, q(c).cast("string")).alias(f"c{i}") for i, c in enumerate(cols)])
    data = raw.select(file.alias("file"), F.col("row_idx").alias("line"), F.to_csv(cells).alias("value"))
    each = spark.range(EXPORT_FILES).select(F.col("id").cast("int").alias("file"))
    named = F.lit(",".join(cols))
    tags = F.concat_ws(",", F.lit(""), *[F.concat(F.lit(f"TAG{i}_"), F.col("file")) for i in range(len(SENSORS))])
    units = F.when(F.col("file") > 0, F.concat(F.lit(",kg"), F.col("file"), F.lit(",%,"))).otherwise(F.lit("," * len(SENSORS)))
    top = each.select("file", F.explode(F.array(*[F.struct(F.lit(k - 3).cast("long").alias("line"), v.alias("value"))
                                                 for k, v in enumerate((named, tags, units))])).alias("h")).select("file", "h.line", "h.value")
    path = scratch_path(spark, "export")
    lines = data.select("file", F.col("line").cast("long").alias("line"), "value").unionByName(top)
    lines.repartition("file").sortWithinPartitions("file", "line").drop("line").write.partitionBy("file").text(path)
    return f"{path}/file=*"


@query
def load_export(spark, sf):
    source, cache = write_tiered(spark, sf), scratch_path(spark, "cache")
    parts = []
    for how, use_cache in (("built", True), ("cached", True), ("bypassed", False)):
        data, meta = landing.load_export(spark, [source], cache, use_cache=use_cache)
        data = data.toDF("ts", *PLAIN)
        sums = data.agg(F.count("*").alias("n"), F.count("ts").alias("n_ts"), *[F.count(c).alias(f"n_{c}") for c in PLAIN],
                        rounded(F.sum("flujo"), 2).alias("sum_flujo"), F.max("ts").alias("last_ts"))
        tiers = meta.agg(F.count("*").alias("n_meta"), F.max(F.when(F.col("variable") == SENSORS[0], F.concat_ws("/", "tag", "unit"))).alias("first_sensor"))
        # one row, taken now: the next load replaces the stored table
        parts.append((how, *sums.first(), *tiers.first()))
    return local_rows(spark, parts, "how string, n bigint, n_ts bigint, n_flujo bigint, n_cons bigint, n_nivel bigint, sum_flujo double, "
                                    "last_ts timestamp, n_meta bigint, first_sensor string")


@query
def header_split(spark, sf):
    data, meta = landing.split_header(tables.raw_export(spark, sf), "row_idx")
    present = profile.schema_inventory(data).select("variable", "n_present")
    return meta.join(present, "variable").select("variable", "tag", "unit", "n_present")


@query
def roundtrip_io(spark, sf):
    df = tables.series_table(spark, sf)
    schema = df.schema
    parquet = landing.materialise(spark, lambda: df, scratch_path(spark, "series"))
    csv = landing.read_landed(spark, landing.write_csv(df, scratch_path(spark, "series")), schema)
    both = parquet.withColumn("store", F.lit("parquet")).unionByName(csv.withColumn("store", F.lit("csv")))
    return shown(
        both.groupBy("store", "event_type").agg(
            F.count("*").alias("n"), F.count("reading").alias("n_reading"), F.avg("value").alias("mean_value"), F.max("ts").alias("last_ts")
        ),
        mean_value=8,
    )


@query
def report_json(spark, sf):
    """All fifteen fields of the five models, written as nested JSON and read back."""
    records = suite_records(spark, sf, checks=True)
    path = landing.export_json(records.select(*evaluate.RECORD_FIELDS), scratch_path(spark, "report"))
    return recorded(spark.read.schema(records.select(*evaluate.RECORD_FIELDS).schema).json(path))


# ---------------------------------------------------------------- cleaning


def typed_export(spark, sf) -> DataFrame:
    raw = tables.raw_export(spark, sf).where("row_idx >= 2").select("row_idx", *[q(c).alias(p) for c, p in zip(SENSORS, PLAIN)])
    return clean.coerce_numeric(raw, PLAIN)


@query
def numeric_coerce(spark, sf):
    return typed_export(spark, sf)


def quarantined(spark, sf):
    raw = tables.raw_export(spark, sf).where("row_idx >= 2").select(F.col("row_idx").alias("line"), *[q(c).alias(p) for c, p in zip(SENSORS, PLAIN)])
    return landing.quarantine(raw, PLAIN, ["line"], scratch_path(spark, "quarantine"))


@query
def quarantined_cells(spark, sf):
    """Cells of the export that hold no reading, with the reason."""
    return quarantined(spark, sf)[1]


@query
def quarantine_counts(spark, sf):
    """What was observed while the export was typed, beside a count of the typed readings."""
    typed, _, seen = quarantined(spark, sf)
    return typed.agg(F.lit(seen["rows"]).cast("bigint").alias("n_rows"), F.lit(seen["rejected"]).cast("bigint").alias("n_rejected"),
                     *[F.count(c).alias(f"n_{c}") for c in PLAIN])


@query
def dropna_all(spark, sf):
    return clean.drop_empty_rows(typed_export(spark, sf).select("row_idx", "flujo", "nivel"), ["flujo", "nivel"])


@query
def null_counts(spark, sf):
    return clean.null_counts(tables.feature_table(spark, sf))


@query
def null_assert(spark, sf):
    p = line_prepared(spark, sf)
    clean.assert_no_nulls(p.scaled)
    before = clean.null_counts(tables.line_table(spark, sf)).agg(F.coalesce(F.sum("n_null"), F.lit(0)).alias("n_before"))
    after = clean.null_counts(p.scaled, only_missing=False).agg(F.sum("n_null").alias("n_after"))
    return before.select(F.lit("before").alias("stage"), F.col("n_before").alias("n_missing")).unionByName(
        after.select(F.lit("after").alias("stage"), F.col("n_after").alias("n_missing"))
    )


@query
def constant_columns(spark, sf):
    spread = clean.column_spread(tables.feature_table(spark, sf), list(tables.NUMERIC))
    flagged = clean.flag_uninformative(spread)
    return shown(flagged.select("variable", "n", "lo", "hi", "std", "dropped"), lo=6, hi=6, std=6)


@query
def low_variance(spark, sf):
    spread = clean.column_spread(tables.feature_table(spark, sf), list(tables.NUMERIC))
    zero = clean.flag_uninformative(spread, var_min=0.0).select("variable", F.col("dropped").alias("var_zero"))
    low = clean.flag_uninformative(spread, var_min=0.01).select("variable", F.col("dropped").alias("var_below"))
    return zero.join(low, "variable")


@query
def feature_select(spark, sf):
    roles = feature_roles(tables.feature_table(spark, sf), WIDE, "charge")
    return local_rows(spark, list(roles.items()), "variable string, role string")


@query
def drop_by_rule(spark, sf):
    df = tables.feature_table(spark, sf)
    exact = clean.exclude_columns(clean.numeric_columns(df), names=["const_col", "null_col", "absent"])
    kept = clean.exclude_columns(exact, contains=["acctbal", "price"], keep=["charge"])
    return clean.null_counts(df, kept, only_missing=False)


@query
def resolve_target(spark, sf):
    df = tables.line_table(spark, sf)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        target = clean.resolve_target(df.columns, "no such column", "charge")
    return shown(profile.target_kpis(df, target, 50_000.0).select(F.lit(target).alias("target"), "n", "mean"), mean=4)


@query
def target_filter(spark, sf):
    df = tables.line_table(spark, sf)
    gaps = df.select("key", F.when(F.col("qty").isNotNull(), F.col("charge")).alias("target"))
    return clean.drop_null_target(gaps, "target")


@query
def median_impute(spark, sf):
    p = line_prepared(spark, sf)
    return p.imputed.select("key", "split", "qty", F.lit(p.medians["qty"]).alias("train_median"))


@query
def standardize(spark, sf):
    p = line_prepared(spark, sf)
    return shown(p.scaled.select("key", "split", *FEATURES), **{c: 8 for c in FEATURES})


@query
def scale_params(spark, sf):
    return shown(line_prepared(spark, sf).params(), mean=6, std_pop=6, median=6)


@query
def prepare_table(spark, sf):
    p = prepare(tables.feature_table(spark, sf), WIDE, "key", ["ts"])
    return shown(p.scaled.drop("ts"), **{c: 7 for c in p.features})


# ---------------------------------------------------------------- domain

# One variable name per rule branch, and one that matches none.
NAME_STEMS = [
    "Unnamed: 0", "CE05_IP21_547FI1019", "Agua de Lavado prensa preblanqueo", "CUMPLE O  NO CUMPLE",
    "Torque Motor Hidraulico D1", "Control Cs entrada prensa D2", "Brillo D0 DCS", "PH etapa D1 indirecta",
    "Pulp to OP Stage", "Nivel Etapa D1", "Nivel Etapa Eop_2", "Flujo CLO2 Etapa D0", "Consistencia Etapa D2",
    "Factor dil prensa pre Blanq. L1", "Concentracion CLO2", "Temperatura Licor",
]


def variable_names(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A sensor catalogue as large as the part table, and tags for a third."""
    part = tables.table(spark, sf, "part")
    stem = F.element_at(F.lit(NAME_STEMS), (F.col("p_partkey") % len(NAME_STEMS) + 1).cast("int"))
    names = part.select("p_partkey", F.concat_ws(" ", stem, "p_brand", "p_partkey").alias("variable"))
    tags = names.where("p_partkey % 3 = 0").select("variable", F.concat(F.lit("CE05_IP21_"), F.col("p_partkey")).alias("tag"))
    return names.select("variable"), tags


@query
def domain_classify(spark, sf):
    return domain.classify(*variable_names(spark, sf))


@query
def category_counts(spark, sf):
    return domain.category_counts(domain.classify(*variable_names(spark, sf)))


# ---------------------------------------------------------------- split


@query
def hash_split(spark, sf):
    return split.hash_split(tables.line_table(spark, sf).select("key"), "key")


@query
def exact_split(spark, sf):
    return split.exact_split(tables.line_table(spark, sf).select("key"), "key")


@query
def hash_sample(spark, sf):
    return split.hash_sample(tables.line_table(spark, sf).select("key", "charge"), "key", 2000)


@query
def fold_assign(spark, sf):
    return split.assign_fold(tables.line_table(spark, sf).select("key"), "key")


# ---------------------------------------------------------------- profile


@query
def describe(spark, sf):
    cols = [*tables.NUMERIC, "charge"]
    out = profile.describe(stage(tables.feature_table(spark, sf).select(*cols)), cols)
    return shown(out, **{c: 5 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


@query
def target_kpis(spark, sf):
    return shown(profile.target_kpis(tables.series_table(spark, sf), "value", LINE.design_limit), mean=8, share_over=8)


@query
def histogram(spark, sf):
    return shown(profile.histogram(tables.series_table(spark, sf), "value"), lo=8, hi=8)


@query
def kde(spark, sf):
    return shown(profile.kde(tables.series_table(spark, sf), "value"), x=8, density=10)


@query
def boxplot(spark, sf):
    return shown(profile.box_stats(tables.series_table(spark, sf), "value"), mean=8, q1=8, median=8, q3=8)


def _summed(df: DataFrame) -> DataFrame:
    """Means shown as sum and count: readings have two decimals, so their sums
    are never halfway between two shown values. Frames that hold a huge reading
    are shown in units of it."""
    total = F.col("rolling_mean") * F.col("rolling_n")
    return df.withColumns({
        "rolling_sum": F.when(F.abs(total) < SPIKE / 1e3, rounded(total, 2)), "rolling_spikes": F.when(F.abs(total) >= SPIKE / 1e3, rounded(total / SPIKE, 6)),
    }).drop("rolling_mean")


@query
def rolling_mean(spark, sf):
    df = tables.series_table(spark, sf).select("event_id", "ts", "reading")
    out = ordering.rolling_mean(df, "reading", ["ts", "event_id"], count_output="rolling_n")
    return _summed(out.withColumn("design_limit", F.lit(LINE.design_limit)))


@query
def rolling_mean_by_series(spark, sf):
    df = tables.series_table(spark, sf).select("event_id", "ts", "event_type", "reading")
    return _summed(ordering.rolling_mean(df, "reading", ["ts", "event_id"], by=["event_type"], rows=240, min_periods=20, count_output="rolling_n"))


@query
def rolling_mean_spiked(spark, sf):
    """A sensor that now and then reports an absurd reading."""
    df = tables.series_table(spark, sf).select("event_id", "ts", "reading")
    df = df.withColumn("reading", F.when(F.col("event_id") % 1009 == 5, F.lit(SPIKE)).otherwise(F.col("reading")))
    return _summed(ordering.rolling_mean(df, "reading", ["ts", "event_id"], count_output="rolling_n"))


# ---------------------------------------------------------------- correlation


def wide_pairs(spark, sf) -> DataFrame:
    return gram.corr_matrix(tables.feature_table(spark, sf), [*tables.NUMERIC, "charge"])


@query
def corr_matrix(spark, sf):
    return shown(wide_pairs(spark, sf).select("col_i", "col_j", "n", "r"), r=8)


@query
def top_corr(spark, sf):
    return shown(gram.top_correlated(wide_pairs(spark, sf), "charge", 18), r=8)


@query
def top10_corr(spark, sf):
    return shown(gram.top_correlated(wide_pairs(spark, sf), "charge", 10, itself=False), r=8)


@query
def top_corr_matrix(spark, sf):
    return shown(gram.top_submatrix(wide_pairs(spark, sf), "charge", 18), r=8)


@query
def corr_prune(spark, sf):
    return gram.correlated_columns(wide_pairs(spark, sf), 0.95, keep=["charge"])


@query
def corr_prune_with_target(spark, sf):
    return gram.correlated_columns(wide_pairs(spark, sf), 0.95)


# ---------------------------------------------------------------- cross products


def _mean_products(spark, sf, by: str | None) -> DataFrame:
    p = line_prepared(spark, sf)
    y_scale = p.label_mean
    unit = p.train.withColumn("charge", F.col("charge") / F.lit(y_scale))
    groups = p.moments(by is not None).groups  # the numbers of rows are known
    sizes = literal_array([groups[g][0, 0] if g in groups else 0.0 for g in range(max(groups) + 1)], "array<double>")
    cells = gram.gram_frame(unit, [*FEATURES, "charge"], by).withColumn("n", F.get(sizes, F.col("grp")))
    out = cells.select("grp", "col_i", "col_j", F.col("n").cast("bigint").alias("n"), (F.col("value") / F.col("n")).alias("mean_product"))
    return shown(out, mean_product=8)


@query
def gram_matrix(spark, sf):
    return _mean_products(spark, sf, None).drop("grp")


@query
def fold_gram(spark, sf):
    return _mean_products(spark, sf, "fold").withColumnRenamed("grp", "fold")


@query
def vif(spark, sf):
    settings = Settings(target="charge", leakage=(), disabled=())
    p = prepare(tables.line_table(spark, sf), settings, "key", ["ts"])
    got = gram.vif(p.moments(False))
    rows = [(name, None if np.isinf(v) else v, bool(np.isinf(v))) for name, v in sorted(got.items(), key=lambda x: -x[1])]
    return shown(local_rows(spark, rows, "variable string, vif double, aliased boolean"), vif=6)


@query
def condition_number(spark, sf):
    m = line_prepared(spark, sf).moments(False)
    rows = [(len(m.features), int(m.n), gram.condition_number(m))]
    return shown(local_rows(spark, rows, "n_features int, n bigint, condition_number double"), condition_number=6)


# ---------------------------------------------------------------- least squares


@query
def ols_simple(spark, sf):
    """One feature, end to end: split, impute, standardise, fit, score."""
    p = line_prepared(spark, sf)
    ols = models.OrdinaryLeastSquares().fit(p.moments().restricted(["price"]), spark)
    scored = evaluate.score_models(p.scaled, [ols], p.label)
    return shown(
        scored.select("split", "n", "r2", "rmse", "mae", F.lit(ols.coefs["price"]).alias("slope"), F.lit(ols.intercept).alias("intercept")),
        r2=9, rmse=5, mae=5, slope=5, intercept=5,
    )


@query
def ols_fit(spark, sf):
    _, _, ols = line_ols(spark, sf)
    out = ols.coefficients(spark).select("feature", "coef")
    return shown(out.unionByName(local_rows(spark, [("(intercept)", ols.intercept)], "feature string, coef double")), coef=5)


@query
def ols_coefficients(spark, sf):
    p, m, _ = line_ols(spark, sf)
    out = diagnostics.coefficient_table(m, spark).drop("p_value")
    return shown(out, coef=5, std_err=6, t_value=4)


@query
def ols_pvalues(spark, sf):
    """Nine features, of which most are noise, so that the probabilities spread."""
    m = nine_prepared(spark, sf).moments()
    return shown(diagnostics.coefficient_table(m, spark).select("feature", "t_value", "p_value"), t_value=4, p_value=8)


@query
def ols_summary(spark, sf):
    p, m, ols = line_ols(spark, sf)
    rss = evaluate.score_models(p.train, [ols], p.label).first()["rss"]
    s = diagnostics.ols_summary(m, spark, rss)
    keys = ("f_statistic", "f_pvalue", "r2", "r2_adj", "aic_loglik", "bic_loglik")
    out = local_rows(spark, [(int(s["n"]), *[s[k] for k in keys])], "n bigint, " + ", ".join(f"{k} double" for k in keys))
    return shown(out, f_statistic=2, f_pvalue=8, r2=9, r2_adj=9, aic_loglik=3, bic_loglik=3)


ITERATED = Settings(target="charge", leakage=("disc_price",), disabled=("price_copy",))


def nine_prepared(spark, sf) -> Prepared:
    return prepare(tables.feature_table(spark, sf), ITERATED, "key", ["ts"])


@query
def ols_iterative(spark, sf):
    """Nine features by conjugate gradients, without their matrix."""
    p = nine_prepared(spark, sf)
    fit = iterative.IterativeLeastSquares().fit_rows(p.train, p.features, p.label)
    out = fit.coefficients(spark).select("feature", "coef")
    return shown(out.unionByName(local_rows(spark, [("(intercept)", fit.intercept)], "feature string, coef double")), coef=5)


@query
def ridge_iterative(spark, sf):
    """Three penalties solved together, in the same passes."""
    p = nine_prepared(spark, sf)
    alphas = [1.0, 100.0, 10_000.0]
    got = iterative.conjugate_gradient(p.train, p.features, p.label, alphas)
    rows = [(k, f, float(b)) for k, fit in enumerate(got.coefs) for f, b in zip(p.features, fit)]
    return shown(local_rows(spark, rows, "alpha_no int, feature string, coef double"), coef=5)


@query
def predict(spark, sf):
    p, _, ols = line_ols(spark, sf)
    return shown(ols.predict(p.scaled).select("key", "split", "fitted"), fitted=2)


@query
def predict_missing_column(spark, sf):
    """A column the model knows and the table lacks counts as zero."""
    p, _, ols = line_ols(spark, sf)
    return shown(ols.predict(p.scaled.drop("tax")).select("key", "fitted"), fitted=2)


@query
def residuals(spark, sf):
    return shown(line_residuals(spark, sf).select("key", "fitted", "resid"), fitted=2, resid=2)


@query
def metrics(spark, sf):
    p, _, ols = line_ols(spark, sf)
    scored = ols.predict(p.scaled).withColumn("model", F.lit("ols"))
    out = evaluate.regression_metrics(scored, label=p.label)
    return shown(out.select("model", "split", "n", "mse", "rmse", "mae", "r2"), mse=2, rmse=5, mae=5, r2=9)


# ---------------------------------------------------------------- residual tests


@query
def jarque_bera(spark, sf):
    return shown(diagnostics.jarque_bera(line_residuals(spark, sf)), skewness=7, kurtosis=7, jb=3, p_value=8)


@query
def durbin_watson(spark, sf):
    return shown(diagnostics.durbin_watson(line_residuals(spark, sf), ORDER), durbin_watson=8)


@query
def breusch_pagan(spark, sf):
    return shown(diagnostics.breusch_pagan(line_residuals(spark, sf), FEATURES), lm=4, p_value=8)


@query
def residual_trend(spark, sf):
    return shown(diagnostics.residual_trend(line_residuals(spark, sf), ORDER), mean_fitted=4, mean_resid=4)


@query
def scale_location(spark, sf):
    return shown(diagnostics.scale_location(line_residuals(spark, sf)).select("key", "scale_location"), scale_location=5)


@query
def qq_points(spark, sf):
    return shown(diagnostics.qq_points(line_residuals(spark, sf)), prob=6, theoretical=8, sample=6)


@query
def residual_sequence(spark, sf):
    return shown(diagnostics.residual_sequence(line_residuals(spark, sf), ORDER), resid=2)


# ---------------------------------------------------------------- selection


@query
def stepwise_step1(spark, sf):
    p = line_prepared(spark, sf)
    m = p.moments(False)
    rows = []
    for f in m.features:
        fit = models.least_squares(m.restricted([f]))
        rows.append((f, fit.rss / fit.tss, models.loglik_aic(fit.n, fit.rss, 1)))
    return shown(local_rows(spark, rows, "feature string, rss_share double, aic double"), rss_share=9, aic=3)


@query
def stepwise_path(spark, sf):
    m = line_prepared(spark, sf).moments(False)
    return shown(models.StepwiseAIC(max_features=25).fit(m, spark).path(spark), aic=3, gain=3)


@query
def forward_cv_select(spark, sf):
    m = line_prepared(spark, sf).moments()
    return shown(models.ForwardCV(n_features=3, scoring="mse").fit(m, spark).path(spark).withColumn("score", -F.col("score")), score=1)


@query
def forward_cv_r2(spark, sf):
    m = line_prepared(spark, sf).moments()
    return shown(models.ForwardCV(n_features="auto", scoring="r2").fit(m, spark).path(spark), score=9)


@query
def forward_cv_quarter(spark, sf):
    """A quarter of the features, as a share."""
    m = line_prepared(spark, sf).moments()
    return shown(models.ForwardCV(n_features=0.25, scoring="mse").fit(m, spark).path(spark).withColumn("score", -F.col("score")), score=1)


def _cv_result(spark, sf, model: models.Penalised) -> DataFrame:
    m = line_prepared(spark, sf).moments()
    model.fit(m, spark)
    spread = models.least_squares(m).tss / m.n
    chosen = (F.col("alpha") == model.best_alpha) & (F.col("ratio") == model.best_ratio)
    return shown(
        model.error_table(spark).select(
            "ratio", "alpha_no", F.col("alpha"), (F.col("cv_mse") / spread).alias("cv_share"), chosen.alias("chosen")
        ),
        alpha=5, cv_share=7,
    )


def _cv_coefs(spark, sf, model: models.Penalised) -> DataFrame:
    m = line_prepared(spark, sf).moments()
    return shown(model.fit(m, spark).coefficients(spark).select("feature", "coef"), coef=3)


@query
def ridge_cv(spark, sf):
    return _cv_result(spark, sf, models.Ridge())


@query
def ridge_coefs(spark, sf):
    return _cv_coefs(spark, sf, models.Ridge())


@query
def lasso_cv(spark, sf):
    return _cv_result(spark, sf, models.Lasso())


@query
def lasso_coefs(spark, sf):
    return _cv_coefs(spark, sf, models.Lasso())


@query
def elasticnet_cv(spark, sf):
    return _cv_result(spark, sf, models.ElasticNet())


@query
def lasso_custom_grid(spark, sf):
    return _cv_result(spark, sf, models.Lasso(alphas=log_grid_values(-3, 3, 100)))


@query
def elasticnet_custom_grid(spark, sf):
    grid = models.ElasticNet(alphas=log_grid_values(-3, 3, 50), ratios=[0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0])
    return _cv_result(spark, sf, grid)


@query
def ridge_custom_grid(spark, sf):
    return _cv_result(spark, sf, models.Ridge(alphas=log_grid_values(-6, 6, 13)))


@query
def ridge_loo(spark, sf):
    p = line_prepared(spark, sf)
    m = p.moments(False)
    spread = models.least_squares(m).tss / m.n
    out = models.ridge_leave_one_out(p.train, m, log_grid_values(-6, 6, 13))
    return shown(out.select("alpha_no", "alpha", (F.col("loo_mse") / spread).alias("loo_share")), alpha=6, loo_share=9)


@query
def ridge_loo_coefs(spark, sf):
    """The ridge model whose penalty leave-one-out chose."""
    p = line_prepared(spark, sf)
    fit = models.RidgeLeaveOneOut(p.train).fit(p.moments(False), spark)
    return shown(fit.coefficients(spark).select("feature", "coef", F.lit(fit.best_alpha).alias("alpha")), coef=4, alpha=6)


# ---------------------------------------------------------------- comparison


def suite_fits(spark, sf) -> tuple[Prepared, list[models.Regression], DataFrame]:
    """The five models of the default suite, fitted and scored."""
    p = line_prepared(spark, sf)
    fitted, _ = evaluate.fit_tolerant(default_suite(LINE), p.moments(), spark)
    return p, fitted, local_copy(evaluate.score_models(p.scaled, fitted, p.label))


def suite_records(spark, sf, checks: bool = False) -> DataFrame:
    p, fitted, metrics = suite_fits(spark, sf)
    found = {}
    if checks:
        rss = metrics.where("model = 'ols' and split = 'train'").first()["rss"]
        found["ols"] = least_squares_checks(p, fitted[0].residuals(p.train, p.label), rss, ORDER)
    return local_copy(evaluate.model_records(metrics, evaluate.model_table(spark, fitted, found)))


def recorded(records: DataFrame) -> DataFrame:
    """All fields of a record; the maps as text, numbers of the tests to six digits."""
    tests = F.transform(F.array_sort(F.map_entries("additional_diagnostics")), lambda e: F.format_string("%s=%.5e", e["key"], e["value"]))
    out = records.select(*evaluate.RECORD_FIELDS[:-2], parameters_shown(format_params(F.col("optimal_hyperparameters"))).alias("params"),
                         F.concat_ws(", ", tests).alias("diagnostics"))
    sides = {f"{side}_{m}": d for side in ("train", "test") for m, d in (("mse", 1), ("rmse", 4), ("mae", 4), ("r2", 8))}
    return shown(out, **sides, adjusted_r2=8, aic=2, bic=2)


def parameters_shown(text: Column) -> Column:
    """A criterion of some 10^6 is shown to one decimal, as far as two engines agree for certain."""
    return F.regexp_replace(text, r"(aic_final=[0-9]+\.[0-9])[0-9]*", "$1")


@query
def model_record(spark, sf):
    return recorded(suite_records(spark, sf, checks=True))


@query
def comparison(spark, sf):
    out = evaluate.comparison_table(suite_records(spark, sf)).toDF(*COMPARED)
    return shown(out.withColumn("params", parameters_shown(F.col("params"))), **COMPARED_DIGITS)


@query
def comparison_chart(spark, sf):
    return shown(evaluate.chart_rows(suite_records(spark, sf)), test_r2=8, test_rmse=4)


@query
def select_best(spark, sf):
    return shown(evaluate.select_best(suite_records(spark, sf)).select("model_name", "test_r2", "num_features_retained"), test_r2=8)


@query
def select_highest(spark, sf):
    return shown(evaluate.select_highest(suite_records(spark, sf)).select("model_name", "test_r2"), test_r2=8)


@query
def suite_predictions(spark, sf):
    """Predictions of all five models, row by row."""
    p, fitted, _ = suite_fits(spark, sf)
    names = [f"fitted_{m.key}" for m in fitted]
    return shown(models.predictions(p.scaled, fitted, names).select("key", "split", *names), **{c: 1 for c in names})


@query
def suite_coefficients(spark, sf):
    """Coefficients of all five models; features a model left out are absent."""
    _, fitted, _ = suite_fits(spark, sf)
    return shown(models.all_coefficients(fitted, spark), coef=3)


@query
def failed_model_row(spark, sf):
    p = line_prepared(spark, sf)
    m = p.moments()

    class Broken(models.OrdinaryLeastSquares):
        key, name = "broken", "OLS broken"

        def fit(self, m, spark):
            raise ArithmeticError("singular")

    fitted, failed = evaluate.fit_tolerant([models.OrdinaryLeastSquares(), Broken()], m, spark)
    records = evaluate.model_records(evaluate.score_models(p.scaled, fitted, p.label), evaluate.model_table(spark, fitted))
    out = evaluate.with_failures(records, failed, {"broken": "OLS broken"}).orderBy(F.desc_nulls_last("test_r2"))
    return shown(out.select("model", "model_name", "test_r2", "error"), test_r2=9)


@query
def nonzero_coefs(spark, sf):
    """Lasso at three penalties on nine features: from all of them to one left."""
    m = nine_prepared(spark, sf).moments()
    rows = []
    for key, alpha in SHRUNK.items():
        fit = models.Lasso(alphas=[alpha]).fit(m, spark)
        rows += [(key, f, fit.coefs[f]) for f in m.features]
    coefs = local_rows(spark, rows, "model string, feature string, coef double")
    kept = models.nonzero(coefs).groupBy("model").agg(F.concat_ws(",", F.sort_array(F.collect_list("feature"))).alias("features"))
    return shown(evaluate.active_features(coefs).join(kept, "model"), sparsity_pct=6)


@query
def top_coefs(spark, sf):
    """The two sides of the largest coefficients, fifteen wide (seven and seven)."""
    ols = models.OrdinaryLeastSquares().fit(nine_prepared(spark, sf).moments(), spark)
    return shown(models.top_coefficients(ols.coefficients(spark), 15).select("feature", "coef"), coef=5)


@query
def top_coefs_by_size(spark, sf):
    """By magnitude, fifteen and ten wide."""
    ols = models.OrdinaryLeastSquares().fit(nine_prepared(spark, sf).moments(), spark)
    both = [models.top_coefficients(ols.coefficients(spark), n, by_abs=True).withColumn("width", F.lit(n)) for n in (15, 10)]
    return shown(both[0].unionByName(both[1]).select("width", "rank", "feature", "coef"), coef=5)


@query
def format_model_params(spark, sf):
    """Parameter text per part: decimals to four places, one key left out."""
    part = tables.table(spark, sf, "part")
    params = F.create_map(
        F.lit("lambda_optimo"), F.col("p_retailprice").cast("string"), F.lit("cv_folds"), F.col("p_size").cast("string"),
        F.lit("variables_seleccionadas"), F.col("p_name"),
    )
    chosen = F.when(F.col("p_partkey") % 7 != 0, params)
    return part.select("p_partkey", format_params(chosen).alias("params"))


def facts_shown(report: DataFrame) -> DataFrame:
    """Test values to six digits, all else as reported."""
    return report.withColumn("value", F.when(F.col("section") == "diagnostics", F.format_string("%.5e", F.col("value").cast("double"))).otherwise(F.col("value")))


@query
def report_facts(spark, sf):
    records = suite_records(spark, sf, checks=True)
    kpis = profile.target_kpis(tables.series_table(spark, sf), "value", LINE.design_limit)
    return facts_shown(evaluate.report_facts(records, evaluate.select_best(records), kpis, LINE))


@query
def run_all(spark, sf):
    """The whole job with its plots: the comparison of the five models."""
    out = run(tables.line_table(spark, sf), LINE, "key", "ts")["comparison"].toDF(*COMPARED)
    return shown(out.withColumn("params", parameters_shown(F.col("params"))), **COMPARED_DIGITS)


@query
def run_outputs(spark, sf):
    """Every other table of the whole job, as a count and a figure."""
    out = run(tables.line_table(spark, sf), LINE, "key", "ts")
    one = lambda name, n, value: out[name].agg(n.alias("n"), value.cast("double").alias("value")).withColumn("output", F.lit(name))
    rows, total = F.count("*"), F.sum
    figures = [
        one("histogram", rows, total("n")), one("density", rows, total("x")), one("box_stats", total("n"), total("n_outliers")),
        one("series", rows, F.count("rolling_mean")), one("top_correlated", rows, F.max(F.when(F.col("variable") == "disc_price", F.col("r")))),
        one("top_correlations", rows, F.max("n")), one("target_kpis", total("n"), F.max("share_over")), one("parameters", rows, total("std_pop")),
        one("classification", rows, F.count_if(F.col("Etapa") == "General")), one("category_counts", rows, total("n")),
        one("residual_trend", rows, total("n")), one("qq_points", rows, F.max("theoretical")), one("scale_location", rows, F.avg("scale_location")),
        one("residual_sequence", rows, F.avg(F.abs("resid"))), one("stepwise_path", rows, F.min("aic")), one("coefficients", rows, F.max("coef")),
        one("metrics", rows, total("n")), one("feature_importance", rows, F.max("coef")), one("train", rows, F.avg("charge")),
        one("scored", rows, F.avg("fitted_ols")), one("ols_coefficients", rows, F.max("coef")),
    ]
    found = figures[0]
    for f in figures[1:]:
        found = found.unionByName(f)
    return shown(found, value=1)


@query
def wide_suite_scores(spark, sf):
    """All three penalised models on every feature, scored in one scan."""
    p = prepare(tables.feature_table(spark, sf), WIDE, "key", ["ts"])
    m = p.moments()
    fitted = [k.fit(m, spark) for k in (models.Ridge(), models.Lasso(), models.ElasticNet())]
    out = evaluate.score_models(p.scaled, fitted, p.label)
    return shown(out.select("model", "split", "n", "rmse", "r2"), rmse=5, r2=9)
