"""Queries of the subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from terrane.llm import queries
from tests.test_queries import TABLES, _rows

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
    con.close()
