"""Every query that has SQL against DuckDB on the same tables, compared as sets of rows."""

import math

import duckdb
import pytest

import __spark_entry__
from terrane.plans import queries as grid_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    yield con
    con.close()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(grid_queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    want = duck.execute(grid_queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(grid_queries.queries()) - set(grid_queries.oracle_sql()):
        assert __spark_entry__.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert (row.total_cells, row.total_void_cells, row.regions, row.cells_flagged) == (32000, 765, 327, 2954)
