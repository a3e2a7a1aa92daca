"""Streams, the engine, its SQL surface and streaming."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tributary.functions import sketches as S
from tributary.operators import aggregates as A
from tributary.plans.engine import Engine
from tributary.plans.sql import NotContinuous, run, to_spark
from tributary.sources.streams import Stream, read_copy, spark_type, split_top
from tributary.streaming import feed, forward

NOW = dt.datetime(2024, 1, 1, 12)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture
def engine(spark):
    e = Engine(spark, clock=lambda: NOW)
    e.create_stream("s", "x integer, y text, z numeric(10, 2)")
    return e


def test_types_and_splitting():
    assert [spark_type(t) for t in ("INTEGER", "int8", "double precision", "varchar(10)", "timestamptz", "numeric(5,1)", "int[]", "jsonb")] == ["int", "bigint", "double", "string", "timestamp", "decimal(5,1)", "array<int>", "string"]
    assert split_top("a, f(b, c), 'd, e', g[1,2]") == ["a", "f(b, c)", "'d, e'", "g[1,2]"]
    for bad in ("x", "x widget", "arrival_timestamp timestamptz", "x int, x int"):
        with pytest.raises(ValueError):
            Stream.of("s", bad)


def test_coercion(spark, engine):
    s = engine.streams["s"]
    r = s.coerce(spark.createDataFrame([("7", 1.5)], "x string, z double"), now=F.lit(NOW)).first()
    assert (r["x"], r["y"], str(r["z"]), r["arrival_timestamp"]) == (7, None, "1.50", NOW)
    assert s.coerce(spark.createDataFrame([("a", 1)], "p string, q int"), ["y", "x"]).columns == ["x", "y", "z", "arrival_timestamp"]
    with pytest.raises(ValueError):
        s.coerce(spark.createDataFrame([(1,)], "nope int"))
    with pytest.raises(ValueError):
        s.coerce(spark.createDataFrame([(1,)], "x int"), ["x", "y"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        s.coerce(spark.createDataFrame([("seven",)], "x string")).collect()
    s.add_column("w", "float8")
    assert s.coerce(spark.createDataFrame([(1,)], "x int")).columns[3] == "w"
    with pytest.raises(ValueError):
        s.add_column("w", "int")


def test_copy(spark, engine, tmp_path):
    (tmp_path / "a.csv").write_text('y;x\n"a;b";1\n;2\n')
    (tmp_path / "a.txt").write_text("1\tone\t\\N\n2\t\\N\t2.5\n")
    assert rows(read_copy(spark, engine.streams["s"], str(tmp_path / "a.csv"), "csv", ["y", "x"], header=True, delimiter=";")) == [("a;b", 1), (None, 2)]
    engine.create_view("v", "s", aggs={"n": A.count("y"), "z": A.sum_("z"), "x": A.sum_("x")})
    engine.copy("s", str(tmp_path / "a.txt"))
    run(engine, f"COPY s (y, x) FROM '{tmp_path}/a.csv' (FORMAT csv, HEADER true, DELIMITER ';')")
    r = engine.read("v").first()
    assert (r["n"], float(r["z"]), r["x"]) == (2, 2.5, 6)
    for bad in ({"format": "binary"}, {"columns": ["q"]}, {"freeze": True}, {"header": True}):
        with pytest.raises(ValueError):
            read_copy(spark, engine.streams["s"], "x", **bad)


def test_a_failing_query_leaves_the_others(spark, engine):
    def broken(df):
        raise RuntimeError("no")

    engine.create_transform("t", "s", broken, output=lambda df: None)
    engine.create_view("v", "s", aggs={"n": A.count()})
    engine.create_transform("idle", "s", broken)  # nothing reads it, so it isn't run
    engine.insert("s", spark.createDataFrame([(1,)], "x int"))
    stats = {r["name"]: r for r in engine.query_stats().collect()}
    assert rows(engine.read("v")) == [(1,)] and stats["t"]["errors"] == 1 and stats["t"]["last_error"] == "no" and stats["idle"]["errors"] == 0


def test_chains_and_names(spark, engine):
    seen = []
    engine.create_view("v", "s", keys={"x": "x"}, aggs={"n": A.count()})
    engine.create_transform("t", engine.output_of("v"), lambda df: df.select("new.x", "new.n"), output=lambda df: seen.extend(rows(df)))
    engine.create_view("w", "t", aggs={"c": A.count(), "hi": A.max_("n")})
    for _ in range(2):
        engine.insert("s", spark.createDataFrame([(1,), (1,), (2,)], "x int"))
    assert seen == [(1, 2), (2, 1), (1, 4), (2, 2)] and rows(engine.read("w")) == [(4, 4)]
    assert rows(engine.get_stream_readers()) == [("s", "v", "view"), ("t", "w", "view"), ("v", "t", "transform")]
    assert [r["name"] for r in engine.get_views().collect()] == ["v", "w"] and engine.get_transforms().count() == 1
    with pytest.raises(ValueError):
        engine.drop("v")
    engine.rename("v", "vv")
    engine.insert("s", spark.createDataFrame([(1,)], "x int"))
    assert rows(engine.read("w")) == [(5, 5)] and "Aggregate" in engine.worker_query("vv") and "Aggregate" in engine.combiner_query("vv")
    engine.drop("s", cascade=True)
    assert not engine.queries and not engine.streams


def test_targets_switches_and_ids(spark, engine):
    for n in ("a", "b"):
        engine.create_view(n, "s", aggs={"n": A.count()})
    one = spark.createDataFrame([(1,)], "x int")
    engine.insert("s", one, targets=["a"], batch_id="1")
    engine.insert("s", one, batch_id="1")
    assert rows(engine.read("a")) == rows(engine.read("b")) == [(1,)]
    assert engine.deactivate("a") and not engine.deactivate("a")
    engine.insert("s", one)
    assert engine.activate("a") and rows(engine.read("a")) == [(1,)] and rows(engine.read("b")) == [(2,)]
    engine.enabled = False
    engine.insert("s", one)
    assert rows(engine.read("b")) == [(2,)]
    for bad in (lambda: engine.insert("s", one, targets=["zz"]), lambda: engine.insert("zz", one), lambda: engine.activate("zz"), lambda: engine.create_view("a", "s"), lambda: engine.create_view("q", "zz"), lambda: engine.read("zz")):
        with pytest.raises(ValueError):
            bad()


def test_windows_tick_into_other_queries(spark, engine):
    engine.create_view("v", "s", aggs={"n": A.count()}, sliding_window="10 s")
    engine.create_view("log", "v", aggs={"c": A.count(), "gone": A.count("old")})
    engine.insert("s", spark.createDataFrame([(1,)], "x int"), as_of=NOW)
    engine.tick(NOW)
    engine.tick(NOW + dt.timedelta(seconds=20))
    assert engine.read("log").first()["gone"] == 1
    assert engine.ttl_expire("v", NOW + dt.timedelta(seconds=20)) == 1


def test_combine_table(spark, engine):
    for n in ("a", "b"):
        engine.create_view(n, "s", keys={"x": "x"}, aggs={"n": A.count(), "z": A.avg("z")})
    engine.insert("s", spark.createDataFrame([(1, 2.0), (2, 4.0)], "x int, z double"))
    engine.combine_table("a", engine.view("b").state())
    assert rows(engine.read("a"), "x", "n") == [(1, 2), (2, 2)]
    with pytest.raises(ValueError):
        engine.combine_table("a", spark.range(1))
    engine.truncate("a")
    with pytest.raises(ValueError):
        engine.read("a")


def test_sql(spark):
    e = Engine(spark, clock=lambda: NOW)
    do = lambda q, **k: run(e, q, **k)
    do("CREATE FOREIGN TABLE s (x integer, y integer, k text, ts timestamp) SERVER any")
    do("CREATE VIEW v WITH (action=materialize) AS SELECT x % 2 AS g, count(*), avg(y) + 1 AS a, count(*) FILTER (WHERE y > 3) AS f, count(DISTINCT k) AS dk, rank(3) WITHIN GROUP (ORDER BY y) AS r FROM s GROUP BY g")
    do("CREATE VIEW sets AS SELECT x, y, count(*) AS n FROM s GROUP BY GROUPING SETS ((x), (x, y), ())")
    do("CREATE VIEW flat AS SELECT x, y, count(*) AS n FROM s GROUP BY GROUPING SETS (x), (x, y)")
    do("CREATE VIEW win WITH (sw='1 hour', sw_column='ts', step_factor=10) AS SELECT count(*) AS n, array_agg(DISTINCT k) AS ks FROM s WHERE x > 0")
    do("CREATE VIEW pred AS SELECT x, minute(ts) AS m, count(*) AS n FROM s WHERE ts > clock_timestamp() - interval '1 hour' GROUP BY x, m")
    do("CREATE VIEW fan AS SELECT x, generate_series(1, 2) AS i FROM s WHERE x = 1")
    do("CREATE VIEW lim AS SELECT DISTINCT x FROM s LIMIT 1 OFFSET 1")
    do("CREATE VIEW ons AS SELECT DISTINCT ON (x) x, k FROM s")
    do("CREATE VIEW chg AS SELECT sum((new).count - coalesce((old).count, 0)) AS d FROM output_of('v')")
    for i in range(3):
        do(f"INSERT INTO s (x, y, k, ts) VALUES ({i}, {i * 2}, 'a', '2024-01-01 11:30:00'), (1, 5, 'b', '2024-01-01 10:00:00'), (2, NULL, 'a', '2024-01-01 11:59:59')")
    assert not [q.error for q in e.queries.values() if q.error]
    assert rows(do("SELECT * FROM v WHERE g = 1")) == [(1, 4, 5.25, 3, 2, 2)]
    assert (1, None, 4) in rows(do("SELECT x, y, n FROM sets")) and len(rows(e.read("flat"))) == 5
    assert e.read("win").first()["n"] == 5 and sorted(e.read("win").first()["ks"]) == ["a"]
    assert (2, dt.datetime(2024, 1, 1, 11, 59), 3) in rows(e.read("pred"))
    assert len(rows(e.read("fan"))) == 8 and len(rows(e.read("lim"))) == 1 and len(rows(e.read("ons"))) == 3
    assert e.read("chg").first()["d"] == 9
    assert rows(do("SELECT combine(count) AS c, combine(dk) AS d FROM v")) == [(9, 2)]
    assert [r["g"] for r in do("SELECT g, combine(count) + 1 AS c FROM v GROUP BY g HAVING combine(count) > 1 ORDER BY g DESC").collect()] == [1, 0]
    assert do("SELECT deactivate('v')") and do("SELECT activate('v')")
    do("ALTER STREAM s ADD COLUMN w float8")
    do("ALTER VIEW ons RENAME TO ons2")
    do("DROP VIEW ons2")
    do("SELECT truncate_continuous_view('fan')")
    assert "ons2" not in e.queries
    with pytest.raises(ValueError):
        do("SELECT * FROM s")
    with pytest.raises(ValueError):
        do("SELECT combine(g) FROM v")
    with pytest.raises(ValueError):
        do("EXPLODE everything")


def test_sql_functions_are_those_of_columns(spark, engine):
    """Functions of sketches in SQL text give what their column versions do, for null too."""
    run(engine, "CREATE VIEW v AS SELECT bloom_agg(x) AS b, freq_agg(x) AS f, topk_agg(x, 3) AS k, dist_agg(x) AS t, bucket_agg(x, x % 3) AS u, hll_agg(x) AS h FROM s")
    engine.insert("s", spark.range(200).selectExpr("CAST(id * id % 37 AS int) AS x"))
    run(engine, "SELECT b, f, k, t, u, h, CAST(i AS int) AS i FROM v LATERAL VIEW explode(sequence(0, 60)) AS i UNION ALL SELECT b, f, k, t, u, h, NULL FROM v").createOrReplaceTempView("probe")
    pairs = {
        "bloom_contains(b, i)": S.bloom_contains("b", "i"), "bloom_cardinality(b)": S.bloom_cardinality("b"), "freq(f, i)": S.freq("f", "i"), "freq_total(f)": S.freq_total("f"), "freq_norm(f, i)": S.freq_norm("f", "i"), "topk_values(k)": S.topk_values("k"), "topk_freqs(k)": S.topk_freqs("k"),
        "dist_quantile(t, 0.3)": S.dist_quantile("t", 0.3), "dist_quantile(t, 1)": S.dist_quantile("t", 1), "dist_cdf(t, 9)": S.dist_cdf("t", "9"), "bucket_ids(u)": S.bucket_ids("u"), "bucket_cardinality(u, 1)": S.bucket_cardinality("u", "1"), "bucket_cardinalities(u)": S.bucket_cardinalities("u"), "hll_cardinality(h)": S.hll_cardinality("h"),
    }
    df = spark.table("probe")
    for text, column in pairs.items():
        got = df.select(F.expr(to_spark(text)).alias("a"), column.alias("b")).collect()
        assert len(got) == 62 and all(r["a"] == r["b"] for r in got), text
    assert rows(run(engine, "SELECT topk(k) FROM v"))[0][1] > 1
    null = spark.sql("SELECT cast(null AS array<struct<k:bigint,v:binary>>) AS b, cast(null AS array<struct<k:bigint,v:bigint>>) AS f").select(*[F.expr(to_spark(t)) for t in ("bloom_contains(b, 1)", "bloom_cardinality(b)", "freq(f, 1)", "freq_total(f)", "freq_norm(f, 1)")]).first()
    assert list(null) == [False, 0, 0, 0, 0.0]


@pytest.mark.parametrize(
    "body",
    [
        "SELECT * FROM s", "SELECT count(*) FROM s HAVING count(*) > 1", "SELECT x FROM s ORDER BY x", "SELECT sum(DISTINCT x) FROM s", "WITH a AS (SELECT 1) SELECT x FROM s", "SELECT rank() OVER (ORDER BY x) AS r FROM s", "SELECT x FROM t",
        "SELECT rank(1) WITHIN GROUP (ORDER BY x DESC) FROM s", "SELECT rank(1, 2) WITHIN GROUP (ORDER BY x) FROM s", "SELECT cume_dist(1) FROM s", "SELECT a.x FROM s a JOIN s b ON a.x = b.x", "SELECT x FROM s UNION SELECT x FROM s", "SELECT x, (SELECT 1) AS q FROM s",
        "SELECT count(*) FROM s WHERE NOT arrival_timestamp > clock_timestamp() - interval '1 minute'", "SELECT count(*) FROM s WHERE x = 1 OR arrival_timestamp > clock_timestamp() - interval '1 minute'", "SELECT count(*) FROM s WHERE arrival_timestamp < clock_timestamp()",
        "SELECT x FROM s WINDOW w AS (ORDER BY x)", "SELECT sum(x) WITHIN GROUP (ORDER BY x) FROM s",
    ],
)
def test_no_view_of(engine, body):
    with pytest.raises(NotContinuous):
        run(engine, f"CREATE VIEW bad AS {body}")


@pytest.mark.parametrize("body", ["SELECT count(*) FROM s", "SELECT x FROM s GROUP BY x", "SELECT DISTINCT x FROM s", "SELECT x FROM s LIMIT 3", "SELECT x AS nope FROM s"])
def test_no_transform_of(engine, body):
    with pytest.raises(NotContinuous):
        run(engine, f"CREATE VIEW bad WITH (action=transform, outputfunc=insert_into_stream('s')) AS {body}")


@pytest.mark.parametrize("options", ["step_factor=5", "sw_column='x'", "colour='red'", "sw='10 s', ttl='5 s', ttl_column='x'", "sw='10 s', step_factor=70", "ttl='5 s'", "pk='nope'"])
def test_no_view_with(engine, options):
    with pytest.raises(ValueError):
        run(engine, f"CREATE VIEW bad WITH ({options}) AS SELECT x, count(*) FROM s GROUP BY x")
    with pytest.raises(NotContinuous):
        run(engine, "CREATE OR REPLACE VIEW bad AS SELECT x FROM s")


def test_streaming_survives_a_restart(spark, tmp_path):
    """Files that come later are added once, also by another engine over the same state and checkpoint."""
    source = tmp_path / "in"
    source.mkdir()

    def go():
        e = Engine(spark, root=f"file://{tmp_path}/state")
        e.create_stream("s", "x int")
        e.create_view("v", "s", keys={"g": "x % 2"}, aggs={"n": A.count()})
        feed(e, "s", spark.readStream.schema("x int").parquet(str(source)), f"file://{tmp_path}/checkpoint", availableNow=True).awaitTermination()
        assert e.queries["v"].error is None
        return rows(e.read("v"))

    spark.range(10).selectExpr("CAST(id AS int) AS x").write.mode("append").parquet(str(source))
    assert go() == [(0, 5), (1, 5)]
    time.sleep(1.1)
    spark.range(3).selectExpr("CAST(id AS int) AS x").write.mode("append").parquet(str(source))
    assert go() == [(0, 7), (1, 6)] and go() == [(0, 7), (1, 6)]


def test_forward(spark, engine):
    engine.create_view("v", "s", aggs={"n": A.count()})
    put = forward(engine, "s", "t")
    for number in (0, 1, 1):
        put(spark.createDataFrame([(1,)], "x int"), number)
    assert rows(engine.read("v")) == [(2,)]


def test_forward_of_two_tables(spark, engine):
    """Batches of two tables have ids of their own."""
    engine.create_view("n", "s", aggs={"n": A.count()})
    for name in ("a", "b", "a"):
        forward(engine, "s", name)(spark.createDataFrame([(1, "x")], "x int, y string"), 0)
    assert rows(engine.read("n")) == [(2,)]


def test_ids_are_kept_forever():
    from tributary.sources.stores import BatchIds

    ids = BatchIds()
    for i in [*range(0, 3000, 2), *range(1, 3000, 2)]:
        ids = ids.plus(f"a/b#{i}") if i % 500 in (0, 1, 2) or i < 40 else ids
    ids = ids.plus("other").plus("x#y").plus("a/b#7")
    assert "a/b#0" in ids and "a/b#39" in ids and "a/b#2501" in ids and "a/b#41" not in ids and "other" in ids and "x#y" in ids and "b#0" not in ids
    assert len(ids.ranges["a/b"]) == 6 and BatchIds(ids.ranges, ids.others).plus("a/b#40").ranges["a/b"][0] == [0, 40]
