"""Corpus queries with SQL equal DuckDB on the same tables, and on odd rows."""

import duckdb
import pytest

from odd import documents
from tools.check_oracle import TABLES, digest
from vigila.llm.queries import LLM_QUERIES

SMALL = "/root/testdata/sf0.001"
WITH_SQL = sorted(n for n, (_, sql) in LLM_QUERIES.items() if sql)


def compare(spark, name, sf_dir, con):
    fn, sql = LLM_QUERIES[name]
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert digest(got, df.columns)[1] == digest(want, cols)[1]
    return got


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    assert compare(spark, name, SMALL, con)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", sorted(set(WITH_SQL) - {"op4_chat_format"}))
def test_equals_sql_on_odd_rows(spark, tmp_path, name, empty):
    df = documents(spark)
    (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = compare(spark, name, str(tmp_path), con)
    assert bool(got) != empty


@pytest.mark.parametrize("empty", [False, True])
def test_chats_on_odd_rows(spark, tmp_path, empty):
    turn = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 6, "bot", "yo"),
            (3, 7, "user", "more"), (4, 0, None, None), (4, None, "user", None), (5, 0, "user", ""), (6, 0, "user", "hi"),
            (6, 0, "user", "hi"), (None, 0, "user", "lost"), (None, 1, None, "lost"), (7, 0, "user", "hi"), (7, 1, "bot", "yo"),
            (7, 2, "user", "x" * 100_000)]
    turn += [(8, i, "user", f"t{i}") for i in range(600)] + [(9, i, "user", f"t{i}") for i in range(590)]
    turn += [(10, i, "user", f"t{i}") for i in range(600)]
    df = spark.createDataFrame(turn, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as rank", "2 as key", "3 as block")
    (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = compare(spark, "op4_chat_format", str(tmp_path), con)
    if not empty:
        kept = {r[0] for r in got}
        assert {8, 3, 7} <= kept and not {1, 2, 9, 10} & kept
        assert max(r[2] for r in got) <= 256
