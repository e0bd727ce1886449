"""Preparation and the end-to-end regression job."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.config import Settings
from loomstat.functions.exprs import nan_to_null, q
from loomstat.operators import clean, diagnostics, domain, evaluate, gram, models, profile, split
from loomstat.operators.ordering import PLACE, placed, rolling_mean, sorted_rows
from loomstat.session import local_rows, scratch_path
from loomstat.sources.landing import write_parquet

log = logging.getLogger(__name__)


@dataclass
class Prepared:
    """Training-ready rows and everything fitted on the way.

    ``imputed`` holds features in their own units, ``scaled`` standardised
    ones; both carry the key columns, the label, ``split`` and ``fold``.
    """

    imputed: DataFrame
    scaled: DataFrame
    label: str
    features: list[str]
    medians: dict[str, float | None]
    scale: dict[str, tuple[float, float]]
    cross: gram.Moments
    dropped_constant: list[str] = field(default_factory=list)
    dropped_leakage: list[str] = field(default_factory=list)

    @property
    def train(self) -> DataFrame:
        return self.scaled.where(F.col("split") == "train")

    @property
    def label_mean(self) -> float:
        return self.cross.shift[self.label]

    def params(self) -> DataFrame:
        """``(feature, median, mean, std_pop)`` fitted on the training rows."""
        rows = [(f, self.medians[f], *self.scale[f]) for f in self.features]
        return local_rows(self.scaled.sparkSession, rows, "feature string, median double, mean double, std_pop double")

    def moments(self, by_fold: bool = True) -> gram.Moments:
        """Cross products of the standardised training rows, known since the
        scale was fitted."""
        return self.cross if by_fold else self.cross.merged()


def column_roles(cols: Sequence[str], label: str, settings: Settings, constant: set[str]) -> dict[str, str]:
    """Role of each column: target, constant, disabled, leakage or feature."""
    roles = {}
    for c in cols:
        if c == label:
            roles[c] = "target"
        elif c in constant:
            roles[c] = "constant"
        elif c in settings.disabled:
            roles[c] = "disabled"
        else:
            roles[c] = "leakage" if c in settings.leakage else "feature"
    return roles


def feature_roles(df: DataFrame, settings: Settings, label: str) -> dict[str, str]:
    cols = clean.numeric_columns(df)
    return column_roles(cols, label, settings, set(clean.constant_columns(df, label, settings.std_tol, cols=cols)))


def mark_rows(df: DataFrame, settings: Settings, key: str) -> DataFrame:
    """Add ``split`` and ``fold``, both decided by the key alone."""
    return df.withColumns({
        "split": split.split_column(q(key), settings.test_ratio, settings.seed),
        "fold": split.fold_column(q(key), settings.folds, settings.seed),
    })


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Store a table once in the shared folder, for jobs that pass over it
    several times; later passes read only the columns they use."""
    spark = df.sparkSession
    return spark.read.parquet(write_parquet(df, scratch_path(spark, label)))


def prepare(df: DataFrame, settings: Settings, key: str, carry: Sequence[str] = (), store: bool = True,
            marked: bool = False) -> Prepared:
    """Drop uninformative and leakage columns, drop rows without target, split,
    impute and standardise with parameters of the training rows only.

    ``key`` identifies a row for the split; ``carry`` names further columns to
    keep (a time axis). Neither is a feature. The rows are read four times, so
    they are stored once with their split unless ``store`` is off; ``marked``
    rows already carry ``split`` and ``fold``.
    """
    label = clean.resolve_target(df.columns, settings.target, settings.secondary_target)
    cols = [c for c in clean.numeric_columns(df) if c not in {key, "split", "fold", *carry}]
    rows = df if marked else mark_rows(df.select(q(key), *[q(c) for c in carry], *[q(c) for c in cols]), settings, key)
    if store:
        rows = stage(rows, "prepared")

    # pass 1: column profile of the whole table, and of the training rows
    in_train = (F.col("split") == "train") & nan_to_null(q(label)).isNotNull()
    fit_on, others = clean.spread_by(rows, cols, in_train)
    constant = {c for c in cols if c != label and (fit_on[c] + others[c]).is_constant(settings.std_tol)}
    roles = column_roles(cols, label, settings, constant)
    features = [c for c in cols if roles[c] == "feature"]
    empty = [f for f in features if fit_on[f].n == 0]
    if empty:
        warnings.warn(f"no training value in {empty}; dropped", stacklevel=2)
        features = [f for f in features if f not in empty]
    keep = [key, *carry, label, *features, "split", "fold"]
    rows = clean.drop_null_target(rows.select(*[q(c) for c in keep]), label)
    train = rows.where(F.col("split") == "train")

    # passes 2 and 3: medians; pass 4: cross products, which give the scale too
    medians = clean.fit_median(train, features, fit_on)
    imputed = clean.impute(rows, medians)
    shift = {**medians, label: fit_on[label].mean}
    raw = gram.moments(imputed.where(F.col("split") == "train"), features, label, "fold", shift)
    scale = raw.scale()
    return Prepared(
        imputed, clean.standardise(imputed, scale), label, features, medians, scale, raw.standardised(),
        [c for c in cols if roles[c] in ("constant", "disabled")],
        [c for c in cols if roles[c] == "leakage"],
    )


def leakage_warning(pairs: DataFrame, label: str, threshold: float = 0.98) -> list[str]:
    """Features so close to the target that they may be parts of it. They are
    reported, not dropped: only the named leakage columns are known to be."""
    hit = gram.corr_with(pairs, label, itself=False).where(F.abs("r") > threshold)
    return sorted(r["variable"] for r in hit.collect())


def default_suite(settings: Settings) -> list[models.Regression]:
    return [
        models.OrdinaryLeastSquares(), models.StepwiseAIC(max_features=settings.max_features),
        models.Ridge(), models.Lasso(), models.ElasticNet(),
    ]


def least_squares_checks(prepared: Prepared, scored: DataFrame, rss: float, order_by: Sequence[str]) -> dict[str, float]:
    """Residual tests and fit measures of a least-squares model, as one record."""
    summary = diagnostics.ols_summary(prepared.moments(), prepared.scaled.sparkSession, rss)
    return {
        **diagnostics.residual_tests(scored, prepared.features, order_by),
        **{k: summary[k] for k in ("condition_number", "f_statistic", "f_pvalue", "r2_adj", "aic_loglik", "bic_loglik")},
    }


def run(
    df: DataFrame,
    settings: Settings,
    key: str,
    ts: str,
    suite: Sequence[models.Regression] | None = None,
    tags: DataFrame | None = None,
    plots: bool = True,
) -> dict[str, DataFrame]:
    """The whole job: classify, explore, prepare, fit, score, compare, report.

    The table is stored once with its split, in time order, so that every
    ordered step has the place of a row instead of its time and key. Passes over
    it: column profile, medians, cross products, one scoring scan for all models,
    and the residual tests of the first model.
    """
    spark = df.sparkSession
    wide = placed(stage(mark_rows(sorted_rows(df, [ts, key]), settings, key), "run"))
    df = wide.drop("split", "fold", PLACE)
    variables = local_rows(spark, [(c,) for c in df.columns if c not in (key, ts)], "variable string")
    classification = domain.classify(variables, tags)
    prepared = prepare(wide, settings, key, [ts, PLACE], store=False, marked=True)
    label = prepared.label
    out: dict[str, DataFrame] = {
        "classification": classification,
        "category_counts": domain.category_counts(classification),
        "target_kpis": profile.target_kpis(df, label, settings.design_limit),
        "parameters": prepared.params(),
    }
    if plots:
        pairs = stage(gram.corr_matrix(df), "pairs")
        suspects = [c for c in leakage_warning(pairs, label) if c not in settings.leakage]
        if suspects:
            log.warning("nearly the target itself, check for leakage: %s", suspects)
        out |= {
            "histogram": profile.histogram(df, label),
            "density": profile.kde(df, label),
            "box_stats": profile.box_stats(df, label),
            "series": rolling_mean(wide.select(q(key), q(ts), q(label), PLACE), label, [PLACE], places=True).drop(PLACE),
            "top_correlated": gram.top_correlated(pairs, label),
            "top_correlations": gram.top_submatrix(pairs, label),
        }

    m = prepared.moments()
    suite = list(suite) if suite is not None else default_suite(settings)
    fitted, failed = evaluate.fit_tolerant(suite, m, spark)
    for name, why in failed.items():
        log.warning("model %s failed: %s", name, why)
    metrics = local_copy(evaluate.score_models(prepared.scaled, fitted, label))

    checks = {}
    ols = next((f for f in fitted if f.key == "ols"), None)
    if ols is not None:
        scored = ols.residuals(prepared.train, label)
        rss = metrics.where("model = 'ols' and split = 'train'").first()["rss"]
        checks["ols"] = least_squares_checks(prepared, scored, rss, [PLACE])
        out["ols_coefficients"] = diagnostics.coefficient_table(m, spark, rss)
        if plots:
            out |= {
                "residual_trend": diagnostics.residual_trend(scored, [ts, key]),
                "qq_points": diagnostics.qq_points(scored),
                "scale_location": diagnostics.scale_location(scored.select(q(key), "fitted", "resid")),
                "residual_sequence": diagnostics.residual_sequence(scored, [ts, key]),
            }
    stepwise = next((f for f in fitted if f.key == "stepwise"), None)
    if stepwise is not None:
        out["stepwise_path"] = stepwise.path(spark)

    table = evaluate.model_table(spark, fitted, checks)
    records = local_copy(evaluate.model_records(metrics, table))
    best = local_copy(evaluate.select_best(records, settings.tolerance))
    coefs = models.all_coefficients(fitted, spark)
    winner = best.first()["model"]
    out |= {
        "coefficients": coefs,
        "metrics": metrics,
        "records": evaluate.with_failures(records, failed, {s.key: s.name for s in suite}),
        "comparison": evaluate.comparison_table(records),
        "best": best,
        "feature_importance": models.top_coefficients(coefs.where(F.col("model") == winner)),
        "report": evaluate.report_facts(records, best, out["target_kpis"], settings),
        "train": prepared.train.drop(PLACE),
        "scored": models.predictions(prepared.scaled, fitted, [f"fitted_{f.key}" for f in fitted]).drop(PLACE),
    }
    return out


def local_copy(df: DataFrame) -> DataFrame:
    """A result of a few rows (one per model) kept as a local relation, so the
    scans behind it run once."""
    return df.sparkSession.createDataFrame(df.toArrow())
