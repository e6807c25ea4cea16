"""Every registered query with oracle SQL equals DuckDB on the same
Parquet tables (row count, column names, order-insensitive values)."""

import duckdb
import pytest

import __spark_entry__ as E
from vigila.plans.queries import REGISTRY
from tools.check_oracle import TABLES, digest
from conftest import SF_SMALL

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in SQLS if n in REGISTRY))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, df.columns)[0] == digest(drows, dcols)[0]


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQLS) if n in REGISTRY))
def test_rows_only_queries_run(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "hist_14d" in df.columns
