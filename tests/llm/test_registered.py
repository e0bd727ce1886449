"""Registered queries of the training-data operators against their SQL."""

import duckdb
import pytest

from loomstat.llm.queries import ORACLE, QUERIES
from tests.test_queries import canonical

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    shared = sorted(want.columns)
    assert set(shared) <= set(got.columns) and len(got) == len(want) > 0
    rows = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in canonical(x[shared])] for x in (got, want)]
    assert rows[0] == rows[1]
