"""Analysis tables assembled from the star-schema parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.session import local_rows

TARGET = "charge"
LEAKAGE = ("disc_price",)
# every numeric column of ``feature_table`` except the target
NUMERIC = (
    "disc_price", "price", "discount", "tax", "qty", "p_size", "p_retailprice",
    "o_totalprice", "s_acctbal", "c_acctbal", "price_copy", "const_col", "null_col",
)
SIGNAL = ("price", "discount", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that need only the fact table: no join, one scan."""
    li = table(spark, sf_dir, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("key"),
        F.col("l_shipdate").alias("ts"),
        (disc * (1 + F.col("l_tax"))).alias("charge"),
        disc.alias("disc_price"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("qty"),
        (F.col("l_extendedprice") * 1.001 + 5).alias("price_copy"),
    )


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide observation table: target, leakage, signal, noise, a collinear
    copy, a constant and an all-null column. No join side is forced to
    broadcast; Catalyst decides from the measured sizes."""
    li = table(spark, sf_dir, "lineitem")
    joined = (
        li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return joined.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("key"),
        F.col("l_shipdate").alias("ts"),
        (disc * (1 + F.col("l_tax"))).alias("charge"),
        disc.alias("disc_price"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("qty"),
        F.col("p_size").cast("double").alias("p_size"),
        F.col("p_retailprice"),
        F.col("o_totalprice"),
        F.col("s_acctbal"),
        F.col("c_acctbal"),
        (F.col("l_extendedprice") * 1.001 + 5).alias("price_copy"),
        F.lit(1.0).alias("const_col"),
        F.lit(None).cast("double").alias("null_col"),
    )


def series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor-like series: one reading per event, some readings missing."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        "event_type",
        F.col("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("reading"),
    )


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of a plant export: all text, a row number, two
    header rows (tags, units) on top, and cells that need cleaning."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    value = F.col("value").cast("string")
    dirty = (
        F.when(i % 13 == 0, F.lit("abc"))
        .when(i % 17 == 0, F.concat(F.lit(" "), value, F.lit(" ")))
        .when(i % 19 == 0, F.lit("1,5"))
        .when(i % 23 == 0, F.lit("NaN"))
        .when(i % 29 == 0, F.lit(None).cast("string"))
        .otherwise(value)
    )
    body = ev.select(
        (i + 2).alias("row_idx"),
        F.lit(None).cast("string").alias("Unnamed: 0"),
        F.lit(None).cast("string").alias("Unnamed: 1"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Unnamed: 2"),
        dirty.alias("Flujo CLO2 Etapa D0"),
        F.col("user_id").cast("string").alias("Cons. Específico  O2 EOP"),
        F.when(i % 5 != 0, F.get_json_object("props", "$.k")).alias("Nivel Etapa D1"),
    )
    header = local_rows(
        spark,
        [
            (0, None, None, None, "CE05_IP21_547AI1133", "CE05_IP21_547FI1201", None),
            (1, None, None, None, "kg/s", "kg/ADt", None),
        ],
        body.schema,
    )
    return header.unionByName(body)
