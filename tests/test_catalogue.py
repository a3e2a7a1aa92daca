"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import tributary.plans.catalogue as catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    assert table(got) == table(con.execute(catalogue.oracle_sql()[name]).df())


def test_flagship(spark):
    rows = catalogue.flagship(spark, D).collect()
    assert len(rows) == 5 and all(r["n"] > 0 and r["p50"] <= r["p99"] for r in rows)


@pytest.fixture(scope="module")
def keyless(con, tmp_path_factory):
    """Tables where some rows have no key to split by, and a connection to them."""
    d, c = tmp_path_factory.mktemp("keyless"), duckdb.connect()
    for name, key in (("events", "event_id"), ("orders", "o_orderkey"), ("conversations", "conv_id"), ("customer", None)):
        change = f"REPLACE (CASE WHEN {key} % 7 < 2 THEN NULL ELSE {key} END AS {key})" if key else ""
        con.execute(f"COPY (SELECT * {change} FROM {name}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["cv_count", "cv_global", "string_agg", "combine_of_deltas", "join_inner", "join_right", "truncate_view", "stream_targets", "deactivated"])
def test_rows_without_a_key(spark, keyless, name):
    """They are counted where the SQL takes the whole table, and not where it names batches by their keys."""
    d, c = keyless
    assert table(catalogue.queries()[name](spark, d).toPandas()) == table(c.execute(catalogue.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Events of one kind with more values than sketches of the usual size hold, and a connection to them."""
    d, c = tmp_path_factory.mktemp("many"), duckdb.connect()
    c.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i // 2 AS user_id, 'view' AS event_type, (i * 7919 % 60000) / 1000 AS value, '{{\"k\": 1}}' AS props FROM range(100000) t(i)) TO '{d}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["bloom_tolerance", "bloom_sets_tolerance", "sql_sketches_tolerance", "topk_sketch"])
def test_many_values(spark, many, name):
    d, c = many
    assert table(catalogue.queries()[name](spark, d).toPandas()) == table(c.execute(catalogue.oracle_sql()[name]).df())


def test_json_object_is_not_sorted_by_one_task(spark, many, monkeypatch):
    """The batch stays in order of event_id over several partitions."""
    d, c = many
    batches, ingest = [], catalogue.View.ingest
    monkeypatch.setattr(catalogue.View, "ingest", lambda self, batch, *a, **b: (batches.append(batch), ingest(self, batch, *a, **b))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalogue.queries()["jsonb_object_agg"](spark, d).toPandas()
        ids = batches[0].select("event_id").rdd.glom().map(lambda rows: [r[0] for r in rows]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table(got) == table(c.execute(catalogue.oracle_sql()["jsonb_object_agg"]).df())
    assert len(ids) > 1 and [i for p in ids for i in p] == list(range(100000))


def test_frequencies_are_joined(spark, many):
    """No map of the whole sketch is built for each user."""
    d, c = many
    df = catalogue.queries()["freq_tolerance"](spark, d)
    assert "map_from_entries" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert table(df.toPandas()) == table(c.execute(catalogue.oracle_sql()["freq_tolerance"]).df())
