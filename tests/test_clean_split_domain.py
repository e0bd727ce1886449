import math

import pytest
from pyspark.sql import functions as F

from loomstat.config import Settings
from loomstat.operators import clean, domain, gram, split
from loomstat.plans.regression import prepare


def test_coercion_of_dirty_cells(spark):
    df = spark.createDataFrame([("1.5",), (" 1.5 ",), ("abc",), ("1,5",), ("NaN",), (None,)], "`a.b c` string")
    assert [r[0] for r in clean.coerce_numeric(df).collect()] == [1.5, 1.5, None, None, None, None]


def test_typing_keeps_a_zone_free_clock_and_rejects_bad_times(spark):
    df = spark.createDataFrame([("2019-04-01 00:02:00", "1", "x")], "when string, `s.1` string, junk string")
    out = clean.clean_types(df, "when", ["junk", "absent"])
    assert out.schema["Timestamp"].dataType.simpleString() == "timestamp_ntz" and out.columns == ["Timestamp", "s.1"]
    with pytest.raises(Exception):
        clean.clean_types(spark.createDataFrame([("not a time",)], "when string"), "when").collect()
    with pytest.warns(UserWarning):
        clean.clean_types(df.drop("when"), "when")


def test_constant_columns_spare_the_label(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, 1e-9, float("nan"), 3.0), (1.0, 6.0, None, 2e-9, 2.0, 3.0)],
        "flat double, ok double, void double, tiny double, single double, label double",
    )
    assert clean.constant_columns(df, "label") == ["flat", "void", "tiny", "single"]
    assert clean.constant_columns(df, "label", var_min=0.0) == ["flat"]
    assert clean.constant_columns(df, None, var_min=0.01) == ["flat", "tiny", "label"]


def test_exclusion_rules():
    cols = ["a", "b total", "c", "y"]
    assert clean.exclude_columns(cols, ["a", "zz"], ["total", "y"], keep=["y"]) == ["c", "y"]
    with pytest.raises(KeyError):
        clean.exclude_columns(cols, ["zz"], strict=True)


def test_null_counts_and_assertion(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x")], "v double, s string")
    assert {r["variable"]: r["n_null"] for r in clean.null_counts(df).collect()} == {"v": 1, "s": 1}
    with pytest.raises(ValueError):
        clean.assert_no_nulls(df)


def test_target_resolution():
    assert clean.resolve_target(["a", "b"], "a") == "a"
    with pytest.warns(UserWarning):
        assert clean.resolve_target(["a", "b"], "z", "b") == "b"
    with pytest.raises(ValueError):
        clean.resolve_target(["a"], "z", "y")


def test_correlated_columns_with_and_without_the_target(spark, dense):
    df = spark.createDataFrame(dense[["a", "b", "y"]]).selectExpr("a", "a * 3 + 1 as a2", "b", "y", "1.0D as flat")
    pairs = gram.corr_matrix(df)
    assert {r[0] for r in gram.correlated_columns(pairs).collect()} == {"a2"}
    assert gram.correlated_columns(pairs, 0.5, keep=["y"]).count() <= gram.correlated_columns(pairs, 0.5).count()
    flat = pairs.where("col_j = 'flat'").collect()
    assert len(flat) == 4 and all(r["r"] is None for r in flat)
    assert pairs.where("col_i = 'a' and col_j = 'a2'").first()["r"] == pytest.approx(1.0)


def test_correlation_uses_rows_where_both_are_present(spark, dense):
    pdf = dense[["a", "b"]].copy()
    pdf.loc[pdf.index % 4 == 0, "a"] = float("nan")
    pdf.loc[pdf.index % 5 == 0, "b"] = float("nan")
    row = gram.corr_matrix(spark.createDataFrame(pdf)).first()
    assert row["r"] == pytest.approx(pdf["a"].corr(pdf["b"])) and row["n"] == pdf.dropna().shape[0]


@pytest.mark.parametrize("parts", [1, 5])
def test_split_and_folds_ignore_partitioning(spark, parts):
    df = spark.range(2000).selectExpr("cast(id as string) as k").repartition(parts)
    rows = {r["k"]: (r["split"], r["fold"]) for r in split.assign_fold(split.hash_split(df, "k"), "k").collect()}
    again = {r["k"]: (r["split"], r["fold"]) for r in split.assign_fold(split.hash_split(df.coalesce(1), "k"), "k").collect()}
    assert rows == again
    share = sum(s == "test" for s, _ in rows.values()) / 2000
    assert 0.17 < share < 0.23
    train = [f for s, f in rows.values() if s == "train"]
    assert set(train) == set(range(5)) and max(train.count(f) for f in range(5)) < 400


@pytest.mark.parametrize("n", [1, 10, 101])
def test_exact_split_size(spark, n):
    out = split.exact_split(spark.range(n), "id")
    assert out.where("split = 'test'").count() == math.ceil(0.2 * n) and out.count() == n


def test_sample_is_whole_when_small(spark):
    assert split.hash_sample(spark.range(50), "id", 2000).count() == 50
    a = split.hash_sample(spark.range(500).repartition(3), "id", 100)
    b = split.hash_sample(spark.range(500).repartition(8), "id", 100)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


EXPECTED = {
    "Unnamed: 0": ("sin_medicion", "Inhabilitado"),
    "CE05_IP21_547FI1019": ("sin_medicion", "Inhabilitado"),
    "Agua de Lavado prensa preblanqueo": ("valor_fijo", "Auxiliar"),
    "CUMPLE O  NO CUMPLE": ("valor_fijo", "Auxiliar"),
    "Torque Motor Hidraulico D1": ("control_elementos", "Etapa D1"),
    "Control Cs entrada prensa D2": ("control_elementos", "Etapa D2 y Almacenamiento"),
    "Brillo D0 DCS": ("criterio_experto", "General"),
    "PH etapa D1 indirecta": ("criterio_experto", "Etapa D1"),
    "Pulp to OP Stage": ("medicion_continua", "Etapa EOP"),
    "Nivel Etapa Eop_2": ("medicion_continua", "Etapa EOP"),
    "Flujo CLO2 Etapa D0": ("medicion_continua", "Etapa D0"),
    "Factor dil prensa pre Blanq. L1": ("medicion_continua", "Pre-Blanqueo"),
    "Concentracion CLO2": ("medicion_continua", "Planta Química / Global"),
    "Temperatura": ("medicion_continua", "General"),
}


def test_classification_rules(spark):
    names = spark.createDataFrame([(n,) for n in EXPECTED], "variable string")
    tags = spark.createDataFrame([("Temperatura", "T-1")], "variable string, tag string")
    rows = {r["Variable"]: r for r in domain.classify(names, tags).collect()}
    got = {k: (r["Categoria_Cod"], r["Etapa"]) for k, r in rows.items()}
    want = {**EXPECTED, "Brillo D0 DCS": ("criterio_experto", "Etapa D0")}
    assert got == want
    assert rows["Temperatura"]["Tag"] == "T-1" and rows["Concentracion CLO2"]["Tag"] == ""
    counts = domain.category_counts(domain.classify(names)).collect()
    assert [r["n"] for r in counts] == sorted((r["n"] for r in counts), reverse=True)


def test_prepare_uses_training_rows_only_and_drops_empty_features(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 17).cast("double").alias("Flujo. x  á"),
        (F.col("id") * 2.0).alias("y"), F.lit(4.0).alias("flat"), F.col("id").cast("double").alias("part of y"),
    )
    marked = split.hash_split(df, "k").withColumn(
        "test only", F.when(F.col("split") == "test", F.col("`Flujo. x  á`") * 1.0)).drop("split")
    settings = Settings(target="y", leakage=("part of y",), disabled=())
    with pytest.warns(UserWarning, match="test only"):
        p = prepare(marked, settings, "k")
    assert p.features == ["Flujo. x  á"] and p.dropped_constant == ["flat"] and p.dropped_leakage == ["part of y"]
    train = p.train.toPandas()["Flujo. x  á"]
    assert train.mean() == pytest.approx(0, abs=1e-12) and train.std(ddof=0) == pytest.approx(1)
    assert set(p.scaled.columns) == {"k", "y", "Flujo. x  á", "split", "fold"}
