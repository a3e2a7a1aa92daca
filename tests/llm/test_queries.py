"""The registered queries, and the two that SQL expresses, against DuckDB."""

import os

import duckdb
import pytest

from tributary.llm import queries as q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def test_names():
    assert [n.split("_")[0] for n in q.queries()] == [f"op{i}" for i in range(1, 11)] and set(q.oracle_sql()) <= set(q.queries())


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = q.queries()[name](spark, D).toPandas(), con.execute(q.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_one_row_a_document(spark, name):
    n = spark.read.parquet(f"{D}/documents.parquet").count()
    rows = q.queries()[name](spark, D).collect()
    assert len({r["doc_id"] for r in rows}) == n and (name.startswith("op5") or len(rows) == n)
