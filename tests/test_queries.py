"""Registered queries against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_DIR

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle_sql()
NAMES = [n for n in SQL if not n.startswith("op") and n != "pipeline"]


def canonical(df: pd.DataFrame) -> list[tuple]:
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(v is None, "" if isinstance(v, (int, float)) else str(v), v if isinstance(v, (int, float)) else 0) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, SF_DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    out = entry(spark)
    assert out.count() == 5 and "test_r2" in out.columns


def test_feature_scan_reads_only_its_columns(spark):
    from loomstat.operators import gram
    from loomstat.sources import tables

    df = gram.gram_rows(tables.line_table(spark, SF_DIR), ["price", "tax"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "l_orderkey" not in schema and "l_extendedprice" in schema and "l_tax" in schema
