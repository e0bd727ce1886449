"""Reading landed exports, splitting tiered headers, caching and exporting."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions import kernels
from loomstat.functions.exprs import q, to_number
from loomstat.session import local_rows

log = logging.getLogger(__name__)
# the CSV default keeps milliseconds only
_STAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path, on whatever file system it is."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018 - resolves the path only
        return True
    except AnalysisException:
        return False


def resolve_path(spark: SparkSession, paths: Sequence[str]) -> str:
    """First path that exists; an error naming all of them otherwise."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"no data at any of {list(paths)}")


def read_landed(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                timestamp_format: str | None = None) -> DataFrame:
    """Parquet when the path says so, else CSV with a header line. Without a
    schema every CSV column is text; types are given, never sampled."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    stamp = timestamp_format or _STAMP
    reader = spark.read.option("header", True).option("timestampFormat", stamp).option("timestampNTZFormat", stamp)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def split_header(df: DataFrame, row_idx: str, n_header: int = 2) -> tuple[DataFrame, DataFrame]:
    """Numbered raw rows into data rows and ``(variable, tag, unit)``.

    Row 0 names the tags, row 1 the units, missing ones become ``N/A``.
    """
    cols = [c for c in df.columns if c != row_idx]
    top = df.where(q(row_idx) < n_header)
    longer = top.select(q(row_idx).alias("_row"), *[q(c).cast("string").alias(c) for c in cols]).unpivot(
        ["_row"], [q(c) for c in cols], "variable", "cell"
    )
    pick = lambda row: F.coalesce(F.max(F.when(F.col("_row") == row, F.col("cell"))), F.lit("N/A"))
    meta = longer.groupBy("variable").agg(pick(0).alias("tag"), pick(1).alias("unit"))
    return df.where(q(row_idx) >= n_header).drop(row_idx), meta


def read_tiered_csv(spark: SparkSession, path: str, n_header: int = 2) -> tuple[DataFrame, DataFrame]:
    """A CSV export whose first lines after the column names are tags and units.

    Header lines are told by their place: the first rows of each file's first
    block, which one task reads in order. Every file has its own; the metadata
    are those of the first file by path. A missing cell becomes ``N/A``.
    """
    raw = read_landed(spark, path)
    names = raw.columns
    cols = [f"c{i}" for i in range(len(names))]  # names may hold dots
    placed = raw.select(*[q(n).alias(c) for n, c in zip(names, cols)], F.col("_metadata.file_path").alias("_file"),
                        (F.col("_metadata.file_block_start") == 0).alias("_first"))
    text = ", ".join(f"{c} string" for c in cols)
    data = placed.mapInArrow(kernels.after_header(cols, n_header), text).toDF(*names)
    head = placed.where("_first").mapInArrow(kernels.header_rows(cols, n_header), f"_file string, _row int, {text}")
    first = head.where(F.col("_file") == head.agg(F.min("_file")).first()[0])
    tiers = {r["_row"]: r for r in first.collect()}  # n_header rows
    cell = lambda k, c: "N/A" if k not in tiers or tiers[k][c] is None else tiers[k][c]
    meta = local_rows(spark, [(n, cell(0, c), cell(1, c)) for n, c in zip(names, cols)], "variable string, tag string, unit string")
    return data, meta


def write_csv(df: DataFrame, path: str) -> str:
    writer = df.write.mode("overwrite").option("header", True)
    writer.option("timestampFormat", _STAMP).option("timestampNTZFormat", _STAMP).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def materialise(spark: SparkSession, build: Callable[[], DataFrame], path: str, use_cache: bool = True) -> DataFrame:
    """The stored table at ``path``, building it when absent or bypassed.

    If it cannot be stored, the built table is used with a warning.
    """
    if use_cache and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    built = build()
    try:
        write_parquet(built, path)
    except Exception as e:  # noqa: BLE001 - a failed cache must not fail the run
        log.warning("could not cache to %s: %s", path, e)
        return built
    return spark.read.parquet(path)


def load_export(spark: SparkSession, sources: Sequence[str], cache: str, ts_col: str = "Unnamed: 2",
                drop: Sequence[str] = ("Unnamed: 0", "Unnamed: 1"), use_cache: bool = True,
                ts_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Landed export to a typed, time-ordered table and its metadata. Both are
    cached side by side, so tags and units survive a cached read."""
    from loomstat.operators.clean import clean_types

    source = resolve_path(spark, sources)
    parts: dict[str, DataFrame] = {}

    def raw(which: str) -> DataFrame:
        if not parts:
            parts["data"], parts["meta"] = read_tiered_csv(spark, source)
        return parts[which]

    def typed() -> DataFrame:
        data = clean_types(raw("data"), ts_col, drop, ts_format=ts_format)
        return data.orderBy("Timestamp") if "Timestamp" in data.columns else data

    return (
        materialise(spark, typed, f"{cache}/data", use_cache),
        materialise(spark, lambda: raw("meta"), f"{cache}/meta", use_cache),
    )


def quarantine(df: DataFrame, columns: Sequence[str], keep: Sequence[str], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Typed rows, rejected cells and their numbers from one scan of raw text.

    Text columns become numbers; a cell that holds something but no finite
    reading is null in the typed rows and appears among the rejected ones as
    ``keep, column, value, reason``. Both are written together, so a later pass
    over either reads files; the counts are observed while they are written.
    """
    cells = []
    for c in columns:
        text, number = q(c), q(c).try_cast("double")
        reason = F.when(number.isNull(), "unreadable").when(F.isnan(number), "not a number")
        cells.append(F.when(text.isNotNull() & reason.isNotNull(), F.struct(F.lit(c).alias("column"), text.alias("value"), reason.alias("reason"))))
    marked = df.select(*[q(c) for c in keep], *[to_number(q(c)).alias(c) for c in columns],
                       F.filter(F.array(*cells), lambda x: x.isNotNull()).alias("_rejected"))
    seen = Observation()
    marked = marked.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_rejected")), F.lit(0)).alias("rejected"))
    write_parquet(marked, path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return back.drop("_rejected"), back.select(*[q(c) for c in keep], F.inline("_rejected")), dict(seen.get)


def export_json(records: DataFrame, path: str) -> str:
    """Nested records as JSON lines; absent values are written as null."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
