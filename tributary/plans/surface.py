"""Queries over what the catalogue's folds leave out: statements, options, refusals, stored states and streams of tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..streaming import feed, forward, work_folder
from . import sql as SQL
from .catalogue import _IN, AS_OF, TYPE, _by_sql, _engine, batches, folded, joined, query, rounded, rows, table
from .engine import Engine
from .view import View


def _folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/surface-{uuid.uuid4().hex}"


def _no_errors(e: Engine) -> Engine:
    if bad := next((f"{n}: {q.error}" for n, q in e.queries.items() if q.error), None):
        raise RuntimeError(bad)
    return e


def _checked(spark: SparkSession, named: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame(list(named.items()), "name string, holds boolean")


def _values(*names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in names) + ") AS t(name, holds)"


# writing to streams


@query("SELECT user_id % 3 AS g, count(*) AS n, sum(user_id)::BIGINT AS s, round(sum(value), 4) AS v FROM (SELECT user_id, value FROM events WHERE value > 5 UNION ALL SELECT * FROM (VALUES (1 + 6, 2.5 * 2), (9, 1.0), (11, 4.0)) AS t(a, b)) GROUP BY g")
def sql_insert_forms(spark, d):
    """INSERT of a query, of expressions, and of a prepared statement's parameters."""
    e = Engine(spark, clock=lambda: AS_OF)
    SQL.run(e, "CREATE STREAM s (user_id bigint, value float8, note text)")
    SQL.run(e, "CREATE VIEW v AS SELECT user_id % 3 AS g, count(*) AS n, sum(user_id) AS s, sum(value) AS v FROM s GROUP BY user_id % 3")
    table(spark, d, "events").createOrReplaceTempView("surface_events")
    SQL.run(e, "INSERT INTO s (user_id, value) SELECT user_id, value FROM (SELECT * FROM surface_events WHERE value > 5) q")
    SQL.run(e, "INSERT INTO s (user_id, value) VALUES (1 + 6, 2.5 * 2), (9, 1.0)")
    SQL.run(e, "INSERT INTO s (user_id, value) VALUES ($1, $2)", args=[11, 4.0])
    return rounded(SQL.run(_no_errors(e), "SELECT g, n, CAST(s AS bigint) AS s, v FROM v"), "v")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, count(*) FILTER (WHERE user_id IS NULL) AS lost FROM events GROUP BY event_type")
def copy_into_stream(spark, d):
    """COPY from delimited files, with a header and columns named."""
    path = _folder(spark)
    table(spark, d, "events").select("value", "event_type", "user_id").write.option("header", True).csv(path)
    e = Engine(spark, clock=lambda: AS_OF)
    SQL.run(e, "CREATE STREAM s (event_type text, user_id bigint, value float8, note text)")
    SQL.run(e, "CREATE VIEW v AS SELECT event_type, count(*) AS n, sum(value) AS s, count(*) FILTER (WHERE user_id IS NULL) AS lost FROM s GROUP BY event_type")
    SQL.run(e, f"COPY s (value, event_type, user_id) FROM '{path}' WITH (FORMAT csv, HEADER true)")
    return rounded(SQL.run(_no_errors(e), "SELECT * FROM v"), "s")


@query("SELECT event_type, sum(round(value)::BIGINT)::BIGINT AS whole, count(*) AS n, 0::BIGINT AS notes FROM (SELECT event_type, trunc(value) AS value FROM events) GROUP BY event_type")
def stream_coercion(spark, d):
    """Values take the types of the stream's columns, columns that are missing are null."""
    e = Engine(spark, clock=lambda: AS_OF)
    e.create_stream("s", "event_type text, whole integer, note text")
    e.create_view("v", "s", keys=TYPE, aggs={"whole": A.sum_("whole"), "n": A.count(), "notes": A.count("note")})
    for b in batches(table(spark, d, "events"), "event_id"):
        e.insert("s", b.select("event_type", F.col("value").cast("string").cast("double").alias("whole")))
    return _no_errors(e).read("v")


@query("SELECT kind, count(*) AS n FROM (SELECT n_name AS kind FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation) GROUP BY kind")
def tables_into_stream(spark, d):
    """Two tables' rows forwarded into one stream, one of them by a second streaming query too."""
    root = _folder(spark)
    e = Engine(spark, root=f"{root}/state", clock=lambda: AS_OF)
    e.create_stream("s", "kind text")
    e.create_view("v", "s", keys={"kind": "kind"}, aggs={"n": A.count()})
    for name, column in (("nation", "n_name"), ("region", "r_name")):
        source = spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet").select(F.col(column).alias("kind"))
        source.writeStream.foreachBatch(forward(e, "s", name)).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start().awaitTermination()
    source = spark.readStream.schema(table(spark, d, "nation").schema).parquet(f"{d}/nation*.parquet").select(F.col("n_name").alias("kind"))
    feed(e, "s", source, f"{root}/again", availableNow=True).awaitTermination()
    return _no_errors(e).read("v")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS even, 3::BIGINT AS failed FROM events")
def failing_reader(spark, d):
    """A reader that fails has its errors counted; the others have every row, and a strict writer is told."""
    e = Engine(spark, clock=lambda: AS_OF)
    t = table(spark, d, "events")
    e.create_stream("events", t.schema)
    e.create_view("bad", "events", prepare=lambda b: b.select("no_such_column"), aggs={"n": A.count()})
    e.create_view("good", "events", aggs={"n": A.count(), "even": A.count().where("event_id % 2 = 0")})
    told = 0
    for b in batches(t, "event_id"):
        try:
            e.insert("events", b, strict=True)
        except RuntimeError:
            told += 1
    return e.read("good").withColumn("failed", F.lit(min(told, e.queries["bad"].stats["errors"])).cast("long"))


# options of sliding windows


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {_IN} GROUP BY event_type")
def sql_sw_options(spark, d):
    """The window as options of the view: its length, its column and its step."""
    e = _by_sql(spark, d, "CREATE VIEW v WITH (sw = '10 days', sw_column = 'ts', step_factor = 5) AS SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-21' GROUP BY event_type")
def sw_step_factor(spark, d):
    """A step of a tenth of the window, as the engine's setting."""
    e = Engine(spark, clock=lambda: AS_OF, step_factor=10)
    t = table(spark, d, "events")
    e.create_stream("events", t.schema)
    e.create_view("v", "events", keys=TYPE, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")
    for b in batches(t, "event_id"):
        e.insert("events", b)
    return _no_errors(e).read("v")


@query("SELECT user_id % 2 AS g, sum(n)::BIGINT AS n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events WHERE time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-21' AND (event_type <> 'click' OR value > 3) AND props IS NOT NULL AND value BETWEEN 1 AND 1000 GROUP BY user_id) GROUP BY g")
def sql_sw_on_sw(spark, d):
    """A plain view over a sliding one, whose window stands beside OR in brackets, IS NOT NULL and BETWEEN."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT user_id, count(*) AS n FROM events WHERE (event_type <> 'click' OR value > 3) AND props IS NOT NULL AND ts > clock_timestamp() - interval '10 days' AND value BETWEEN 1 AND 1000 GROUP BY user_id")
    return SQL.run(e, "SELECT user_id % 2 AS g, CAST(sum(n) AS bigint) AS n, count(*) AS users FROM v GROUP BY user_id % 2")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {_IN.replace('ts,', 'ts + INTERVAL 1 HOUR,')} GROUP BY event_type")
def sql_sw_expression(spark, d):
    """A window on an expression."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, count(*) AS n FROM events WHERE ts + interval '1 hour' > clock_timestamp() - interval '10 days' GROUP BY event_type")
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT user_id % 5 AS g, count(*) AS groups, sum(n)::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-26' GROUP BY user_id) GROUP BY g")
def sw_with_readers(spark, d):
    """A sliding view's readers hear of it at ticks: inserts raise nothing, and what came less what went is what is there."""
    e = Engine(spark, root=_folder(spark), clock=lambda: AS_OF)
    t = table(spark, d, "events")
    e.create_stream("events", t.schema)
    e.create_view("w", "events", keys={"user_id": "user_id"}, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")
    one = {"g": "coalesce(new.user_id, old.user_id) % 5"}
    e.create_view("r", "w", keys=one, aggs={"groups": A.sum_("int(new IS NOT NULL) - int(old IS NOT NULL)"), "n": A.sum_("coalesce(new.n, 0) - coalesce(old.n, 0)")})
    for b in batches(t, "event_id"):
        e.insert("events", b)
    for later in (0, 2, 5):
        e.tick(AS_OF + dt.timedelta(days=later))
    return _no_errors(e).read("r").select("g", F.col("groups").cast("long").alias("groups"), F.col("n").cast("long").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-21' AND time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-21' GROUP BY event_type")
def late_rows(spark, d):
    """Rows that come when their window has passed are left out; older batches may still come after newer ones."""
    view = View("v", keys=TYPE, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")
    t = table(spark, d, "events")
    for b in (t.where("ts >= timestamp_ntz'2024-01-25 00:00:00'"), t.where("ts < timestamp_ntz'2024-01-25 00:00:00'")):
        view.ingest(b, as_of=AS_OF)
    return view.read(AS_OF)


@query("SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') AS step, count(*) AS n FROM events WHERE time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-21' GROUP BY step")
def sw_expiry(spark, d):
    """Steps that the window has left go from the state."""
    view = View("v", aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")
    for b in batches(table(spark, d, "events"), "event_id"):
        view.ingest(b)
    view.expire(AS_OF)
    return view.state().select(F.col("_bucket").alias("step"), F.col("n__v").alias("n"))


# states in tables


@query("SELECT count(*) AS groups, count(*) FILTER (WHERE changes > 0) AS changed, sum(n)::BIGINT AS n FROM (SELECT user_id, count(DISTINCT event_id % 9) AS changes, count(*) AS n FROM events GROUP BY user_id)")
def output_stream_from_tables(spark, d):
    """Nine batches into stored states, merged on the way, with a reader of the changes that misses none."""
    e = Engine(spark, root=_folder(spark), clock=lambda: AS_OF)
    t = table(spark, d, "events").select("user_id", "event_id")
    e.create_stream("events", t.schema)
    e.create_view("per", "events", keys={"user_id": "user_id"}, aggs={"n": A.count()})
    e.view("per").store.most = 2
    e.create_view("sums", "per", aggs={"groups": A.sum_("CASE WHEN old IS NULL THEN 1L ELSE 0L END"), "changed": A.exact_count_distinct("new.user_id"), "n": A.sum_("new.n - coalesce(old.n, 0L)")})
    for i in range(9):
        e.insert("events", t.where(f"pmod(coalesce(event_id, 0), 9) = {i}"), batch_id=f"source#{i}")
    e.insert("events", t.where("pmod(event_id, 9) = 3"), batch_id="source#3")
    return _no_errors(e).read("sums")


@query("SELECT event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type")
def state_edited(spark, d):
    """A row of a view's state removed by hand."""
    view = folded(spark, d, keys=TYPE, aggs={"mean": A.avg("value"), "n": A.count()})
    view.store.replace(view.state().where("event_type <> 'view'"))
    return rounded(view.read(), "mean")


@query("SELECT seg, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE 'then ' || c_mktsegment END AS seg FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY seg")
def join_sees_table_at_batch(spark, d):
    """A joined table that changes between two batches: each batch sees it as it was."""
    root = _folder(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    e = Engine(spark, root=f"{root}/state", clock=lambda: AS_OF)
    t = table(spark, d, "orders")
    e.create_stream("orders", t.schema)
    now = {}
    e.create_view("v", "orders", prepare=lambda b: b.join(spark.read.parquet(now["path"]), F.col("o_custkey") == F.col("c_custkey")), keys={"seg": "c_mktsegment"}, aggs={"n": A.count()})
    for i in range(2):
        now["path"] = f"{root}/customer{i}"
        c.withColumn("c_mktsegment", F.concat(F.lit("then " if i else ""), F.col("c_mktsegment"))).write.parquet(now["path"])
        e.insert("orders", t.where(f"pmod(coalesce(o_orderkey, 0), 2) = {i}"))
    return _no_errors(e).read("v")


@query("SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def join_partitioned_table(spark, d):
    """A table partitioned by the column that a condition is on."""
    path = _folder(spark)
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("customer_parts")
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT c_mktsegment, count(*) AS n, sum(c_custkey) AS s FROM orders JOIN customer_parts ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment", source="orders", split="o_orderkey")
    return SQL.run(e, "SELECT c_mktsegment, n, CAST(s AS bigint) AS s FROM v")


@query("SELECT seg, count(*) AS n FROM (SELECT lower(c_mktsegment) AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) GROUP BY seg")
def join_in_transform(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("surface_customer")
    e = _by_sql(
        spark, d, "CREATE STREAM found (seg text)", "CREATE VIEW t WITH (action=transform, outputfunc=insert_into_stream('found')) AS SELECT lower(c_mktsegment) AS seg FROM orders JOIN surface_customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
        "CREATE VIEW v AS SELECT seg, count(*) AS n FROM found GROUP BY seg", source="orders", split="o_orderkey",
    )
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT upper(event_type) AS event_type, count(*) AS n FROM events GROUP BY event_type)")
def transform_to_function(spark, d):
    """A transform whose output function writes what it gets to a table."""
    path, got = _folder(spark), []

    def write(df: DataFrame) -> None:
        df.write.mode("append").parquet(path)
        got.append(1)

    t = table(spark, d, "events")
    e = Engine(spark, clock=lambda: AS_OF)
    e.create_stream("events", t.schema)
    SQL.run(e, "CREATE VIEW t WITH (action=transform, outputfunc=write) AS SELECT upper(event_type) AS kind FROM events", functions={"write": write})
    for b in batches(t, "event_id"):
        e.insert("events", b)
    _no_errors(e)
    return spark.read.parquet(path).selectExpr("kind AS event_type").groupBy("event_type").agg(F.count("*").alias("n")).selectExpr("event_type", "n", "CAST(row_number() OVER (ORDER BY n DESC, event_type) AS bigint) AS place")


# combining by SQL


@query("WITH c AS (SELECT user_id % 4 AS g, avg(value) AS m, count(*) AS n FROM events GROUP BY g) SELECT g, round(m, 6) AS m, n, (SELECT count(*) FROM events) AS total FROM c")
def sql_combine_nested(spark, d):
    """combine() in a CTE and in a scalar subquery."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY user_id")
    out = SQL.run(e, "WITH c AS (SELECT user_id % 4 AS g, combine(m) AS m, combine(n) AS n FROM v GROUP BY user_id % 4) SELECT g, m, n, (SELECT combine(n) AS n FROM v) AS total FROM c")
    return rounded(out, "m", digits=6)


@query("SELECT c_mktsegment, round(avg(o_totalprice), 4) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def sql_combine_joined(spark, d):
    """combine() over a view joined with a table, by the table's column."""
    table(spark, d, "customer").createOrReplaceTempView("surface_customer")
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT o_custkey, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY o_custkey", source="orders", split="o_orderkey")
    return rounded(SQL.run(e, "SELECT c_mktsegment, combine(m) AS m, combine(n) AS n FROM v JOIN surface_customer ON o_custkey = c_custkey GROUP BY c_mktsegment"), "m")


@query("SELECT event_type, round(avg(value), 6) AS m, count(*) AS n FROM events GROUP BY event_type")
def sql_combine_deltas(spark, d):
    """A view of a view's changes that combines their states."""
    e = _by_sql(
        spark, d, "CREATE VIEW v AS SELECT event_type, user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY event_type, user_id",
        "CREATE VIEW w AS SELECT (new).event_type AS event_type, combine((delta).m) AS m, combine((delta).n) AS n FROM output_of('v') GROUP BY (new).event_type",
    )
    return rounded(SQL.run(e, "SELECT * FROM w"), "m", digits=6)


# groups and values


@query("SELECT g, count(*) AS n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS g FROM events) GROUP BY g")
def null_groups(spark, d):
    """Null keys are one group over all batches."""
    return rows(spark, d, keys={"g": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END"}, aggs={"n": A.count()})


@query("SELECT event_type, count(*) AS n, 1 AS one, 'x' AS word FROM events GROUP BY event_type")
def sql_constants(spark, d):
    """Constants among the results of a view."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, count(*) AS n, 1 AS one, 'x' AS word FROM events GROUP BY event_type")
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT event_type, sum(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::BIGINT AS total, floor(avg(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6)::BIGINT AS mean FROM events GROUP BY event_type")
def interval_sums(spark, d):
    """Sums and means of intervals."""
    since = "ts - timestamp_ntz'2024-01-01 00:00:00'"
    out = rows(spark, d, keys=TYPE, aggs={"t": A.sum_(since), "m": A.avg(since)})
    micros = lambda c: f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00' + {c})"
    return out.selectExpr("event_type", f"{micros('t')} AS total", f"CAST(floor({micros('m')} / 1e6) AS bigint) AS mean")


@query("SELECT event_type, string_agg(user_id || '-' || event_id, ',' ORDER BY user_id, event_id) AS pairs FROM events WHERE value > 100 GROUP BY event_type")
def array_agg_of_arrays(spark, d):
    out = rows(spark, d, keys=TYPE, aggs={"p": A.array_agg("array(user_id, event_id)", ordered=True)}, where="value > 100")
    return out.select("event_type", F.array_join(F.transform("p", lambda x: F.array_join(x.cast("array<string>"), "-")), ",").alias("pairs"))


@query("SELECT event_type, '{' || string_agg('\"' || u || '\":' || e, ',' ORDER BY u) || '}' AS o FROM (SELECT event_type, (user_id % 4)::VARCHAR AS u, max(event_id) AS e FROM events GROUP BY ALL) GROUP BY event_type")
def jsonb_object_agg(spark, d):
    """The last value of each key: batches in order of event_id, rows in order within."""
    view = View("v", keys=TYPE, aggs={"o": A.jsonb_object_agg("CAST(user_id % 4 AS string)", "event_id")})
    t = table(spark, d, "events")
    view.ingest(t.orderBy("event_id"))
    return view.read()


@query("SELECT event_type, sum(k)::BIGINT AS k, 3 * count(*) AS l FROM (SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY event_type")
def json_sums_nested(spark, d):
    """Sums by innermost field: arrays count for their field, text that looks like a field is none."""
    e = table(spark, d, "events").withColumn("j", F.concat(F.lit('{"o": {"a \\"x\\": 9": [1, 2], "k": '), F.get_json_object("props", "$.k"), F.lit("}}")))
    view = View("v", keys=TYPE, aggs={"s": A.json_object_int_sum("j")})
    for b in batches(e, "event_id"):
        view.ingest(b)
    got = F.from_json("s", "map<string,bigint>")
    return view.read().select("event_type", got["k"].alias("k"), got['a "x": 9'].alias("l"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.25), 6) AS p25, round(min(value), 6) AS p0 FROM events WHERE user_id < 20 GROUP BY event_type")
def percentile_one(spark, d):
    """Exact percentiles, one at a time, of a part of the rows."""
    aggs = {n: A.percentile_cont(p, "value", exact=True).where("user_id < 20") for n, p in (("p50", 0.5), ("p25", 0.25), ("p0", 0.0))}
    return rounded(rows(spark, d, keys=TYPE, aggs=aggs, where="user_id < 20"), *aggs, digits=6)


# functions of the dialect


@query("""SELECT c_custkey, trim(c_name, '#') AS bt, 'ab' || 'XY' || 'ef' AS ov, round(pi(), 6) AS p, round(acos(0.5), 6) AS ac, log10(100) AS lg, to_timestamp(c_custkey)::TIMESTAMP AS ts, len([1, 2, 3]) AS al, 3 AS jl, 2 AS jb,
c_custkey::VARCHAR AS tx, trunc(c_acctbal)::BIGINT AS tr, 'b' AS el, 1 AS jk, true AS has FROM customer""")
def sql_scalar_functions(spark, d):
    """Functions and casts of the dialect over a view."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT c_custkey, c_name, c_acctbal, count(*) AS n FROM customer GROUP BY c_custkey, c_name, c_acctbal", source="customer", split="c_custkey")
    return SQL.run(e, """SELECT c_custkey, btrim(c_name, '#') AS bt, overlay('abcdef' placing 'XY' from 3 for 2) AS ov, round(pi(), 6) AS p, round(acos(0.5), 6) AS ac, log(100) AS lg, CAST(to_timestamp(c_custkey) AS timestamp_ntz) AS ts,
    CAST(array_length(array(1, 2, 3), 1) AS bigint) AS al, json_array_length('[1, 2, 3]') AS jl, jsonb_array_length('[1, 2]') AS jb, c_custkey::text AS tx, CAST(trunc(c_acctbal) AS bigint) AS tr, (array('a', 'b'))[1] AS el,
    CAST(get_json_object('{"k": 1}', '$.k') AS int) AS jk, now() IS NOT NULL AND struct(1, 2) = struct(1, 2) AS has FROM v""")


@query("SELECT x, count(*) AS n FROM (SELECT unnest(generate_series(1, 3)) AS x FROM events) GROUP BY x UNION ALL SELECT k + 1000, n FROM (SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY k)")
def sql_set_returning(spark, d):
    """Rows made of series, and fields by arrow."""
    e = _by_sql(spark, d, "CREATE VIEW s AS SELECT generate_series(1, 3) AS x, count(*) AS n FROM events GROUP BY x", "CREATE VIEW k AS SELECT CAST(props ->> 'k' AS bigint) AS k, count(*) AS n FROM events GROUP BY CAST(props ->> 'k' AS bigint)")
    return SQL.run(e, "SELECT CAST(x AS bigint) AS x, n FROM s UNION ALL SELECT k + 1000, n FROM k")


@query("SELECT n_name AS name, upper(part) AS part, key, value FROM (SELECT n_name, unnest(['a', 'b']) AS part FROM nation), (VALUES ('k', '7')) AS t(key, value)")
def sql_unnest(spark, d):
    """unnest() and json_each() in a view of rows."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT n_name AS name, unnest(array('a', 'b')) AS part FROM nation", source="nation", split="n_nationkey")
    SQL.run(e, "SELECT * FROM v").createOrReplaceTempView("surface_parts")
    return spark.sql(SQL.to_spark("""SELECT name, upper(part) AS part, jsonb_each('{"k": 7}') AS (key, value) FROM surface_parts"""))


@query("SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 2 * user_id + 1 ELSE 0 END)::BIGINT AS s, count(*) AS n FROM events GROUP BY event_type")
def sql_own_function(spark, d):
    """A user's function in a view, and a user's aggregate with its own merge."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION surface_odd(x BIGINT) RETURNS BIGINT RETURN CASE WHEN x % 2 = 0 THEN 2 * x + 1 ELSE 0 END")
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, sum(surface_odd(user_id)) AS s, count(*) AS n FROM events GROUP BY event_type")
    return SQL.run(e, "SELECT event_type, CAST(s AS bigint) AS s, n FROM v")


@query("SELECT event_type, round(sqrt(sum(value * value)), 4) AS norm FROM events GROUP BY event_type")
def own_aggregate(spark, d):
    """An aggregate of a user's own: how it is made, merged and finished, used by its name in SQL."""
    from ..operators.aggregate import Agg, Part

    def norm(x) -> Agg:
        return Agg("vector_norm", (Part("s", lambda keep: F.sum(keep(F.expr(x) * F.expr(x))), F.sum),), lambda s: F.sqrt(s))

    A.register("vector_norm", norm)
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, vector_norm(value) AS norm FROM events GROUP BY event_type")
    return rounded(SQL.run(e, "SELECT * FROM v"), "norm")


@query("SELECT 3::BIGINT AS f2, 5::BIGINT AS total, 'a,b' AS items, '5,1' AS counts, 0::BIGINT AS none, '[ (a, 5), (b, 1) ]' AS shown, 0::BIGINT AS h")
def sql_sketch_edits(spark, d):
    """Finished sketches made and changed by scalar functions."""
    return spark.sql(SQL.to_spark("""SELECT freq(f, 2) AS f2, freq_total(f) AS total, array_join(topk_values(t), ',') AS items, array_join(topk_freqs(t), ',') AS counts, freq(cmsketch_empty(), 1) AS none, topk_print(t) AS shown, hll_cardinality(hll_empty()) AS h
    FROM (SELECT freq_add(freq_add(cmsketch_empty(), 2, 3), 9, 2) AS f, topk_increment(topk_increment(topk_increment(topk_empty(), 'b'), 'a', 4), 'a') AS t) q"""))


# the catalogue and its switches


@query(_values("activate twice", "deactivate", "flush", "set_ttl", "streams", "views", "transforms", "readers", "targets unknown", "disabled", "rename", "drop needs cascade", "drop cascade"))
def administration(spark, d):
    """Switching, renaming, dropping and asking what there is, as it should come out."""
    e = Engine(spark, clock=lambda: AS_OF)
    for text in ("CREATE STREAM s (x integer, y text)", "CREATE STREAM o (y text)", "CREATE VIEW v AS SELECT y, count(*) AS n, max(arrival_timestamp) AS t FROM s GROUP BY y", "CREATE VIEW t WITH (action=transform, outputfunc=insert_into_stream('o')) AS SELECT y FROM s"):
        SQL.run(e, text)
    out = {"activate twice": SQL.run(e, "SELECT activate('v')") is False, "deactivate": SQL.run(e, "SELECT deactivate('v')") is True and SQL.run(e, "SELECT activate('v')") is True}
    SQL.run(e, "INSERT INTO s VALUES (1, 'a'), (2, 'b')")
    SQL.run(e, "SELECT flush()")
    out["flush"] = SQL.run(e, "SELECT * FROM v").count() == 2
    SQL.run(e, "SELECT set_ttl('v', '1 day', 't')")
    out["set_ttl"] = SQL.run(e, "SELECT ttl_expire('v')", as_of=AS_OF + dt.timedelta(days=2)) == 2
    names = lambda df, c: sorted(r[c] for r in df.collect())
    out |= {"streams": names(e.get_streams(), "name") == ["o", "s"], "views": names(e.get_views(), "name") == ["v"], "transforms": names(e.get_transforms(), "into") == ["o"], "readers": names(e.get_stream_readers(), "reader") == ["t", "v"]}
    out["targets unknown"] = _fails(lambda: SQL.run(e, "INSERT INTO s VALUES (1, 'a')", targets=["nobody"]))
    e.enabled = False
    SQL.run(e, "INSERT INTO s VALUES (1, 'a')")
    e.enabled = True
    out["disabled"] = SQL.run(e, "SELECT * FROM v").count() == 0
    SQL.run(e, "ALTER VIEW v RENAME TO w")
    out["rename"] = names(e.get_views(), "name") == ["w"]
    out["drop needs cascade"] = _fails(lambda: SQL.run(e, "DROP STREAM s"))
    SQL.run(e, "DROP STREAM s CASCADE")
    out["drop cascade"] = names(e.get_streams(), "name") == ["o"] and not e.queries
    return _checked(spark, out)


def _fails(f) -> bool:
    try:
        f()
    except Exception:
        return True
    return False


_REFUSED = {
    "not a select": "CREATE VIEW {} AS VALUES (1)", "cte": "CREATE VIEW {} AS WITH q AS (SELECT 1) SELECT x, count(*) FROM s GROUP BY x", "having": "CREATE VIEW {} AS SELECT x, count(*) FROM s GROUP BY x HAVING count(*) > 1",
    "window function": "CREATE VIEW {} AS SELECT x, row_number() OVER (ORDER BY x) FROM s", "order by": "CREATE VIEW {} AS SELECT x FROM s ORDER BY x", "no stream": "CREATE VIEW {} AS SELECT 1 AS x FROM range(3)", "two streams": "CREATE VIEW {} AS SELECT s.x FROM s JOIN o ON s.y = o.y",
    "distinct sum": "CREATE VIEW {} AS SELECT sum(DISTINCT x) FROM s", "distinct with a window": "CREATE VIEW {} AS SELECT DISTINCT x FROM s WHERE arrival_timestamp > clock_timestamp() - interval '1 hour'", "two windows": "CREATE VIEW {} AS SELECT count(*) FROM s WHERE arrival_timestamp > clock_timestamp() - interval '1 hour' AND arrival_timestamp > clock_timestamp() - interval '2 hours'",
    "window under or": "CREATE VIEW {} AS SELECT count(*) FROM s WHERE x = 1 OR arrival_timestamp > clock_timestamp() - interval '1 hour'", "window under not": "CREATE VIEW {} AS SELECT count(*) FROM s WHERE NOT arrival_timestamp > clock_timestamp() - interval '1 hour'", "window of another form": "CREATE VIEW {} AS SELECT count(*) FROM s WHERE arrival_timestamp < clock_timestamp()",
    "descending sort key": "CREATE VIEW {} AS SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x DESC) FROM s", "row as sort key": "CREATE VIEW {} AS SELECT rank(1) WITHIN GROUP (ORDER BY struct(x, y)) FROM s", "no WITHIN GROUP": "CREATE VIEW {} AS SELECT rank(1) FROM s", "too few values": "CREATE VIEW {} AS SELECT rank(1) WITHIN GROUP (ORDER BY x, y) FROM s",
    "no streaming variant": "CREATE VIEW {} AS SELECT mode() WITHIN GROUP (ORDER BY x) FROM s", "window below a second": "CREATE VIEW {} WITH (sw = '100 milliseconds') AS SELECT count(*) FROM s", "window and option": "CREATE VIEW {} WITH (sw = '1 hour') AS SELECT count(*) FROM s WHERE arrival_timestamp > clock_timestamp() - interval '1 hour'",
    "sw_column alone": "CREATE VIEW {} WITH (sw_column = 'x') AS SELECT count(*) FROM s", "step_factor alone": "CREATE VIEW {} WITH (step_factor = 5) AS SELECT count(*) FROM s", "step_factor above 50": "CREATE VIEW {} WITH (sw = '1 hour', step_factor = 60) AS SELECT count(*) FROM s", "ttl without column": "CREATE VIEW {} WITH (ttl = '1 hour') AS SELECT count(*) FROM s",
    "ttl column unknown": "CREATE VIEW {} WITH (ttl = '1 hour', ttl_column = 'z') AS SELECT count(*) FROM s", "pk unknown": "CREATE VIEW {} WITH (pk = 'z') AS SELECT x, count(*) FROM s GROUP BY x", "option unknown": "CREATE VIEW {} WITH (colour = 'red') AS SELECT count(*) FROM s", "union": "CREATE VIEW {} AS SELECT x FROM s UNION SELECT x FROM s",
    "star": "CREATE VIEW {} AS SELECT * FROM s", "scalar subquery": "CREATE VIEW {} AS SELECT x, (SELECT 1) AS y FROM s", "replace": "CREATE OR REPLACE VIEW {} AS SELECT x FROM s", "aggregate in a transform": "CREATE VIEW {} WITH (action=transform) AS SELECT count(*) FROM s", "group by in a transform": "CREATE VIEW {} WITH (action=transform) AS SELECT x FROM s GROUP BY x",
    "distinct in a transform": "CREATE VIEW {} WITH (action=transform) AS SELECT DISTINCT x FROM s", "limit in a transform": "CREATE VIEW {} WITH (action=transform) AS SELECT x FROM s LIMIT 1", "transform columns": "CREATE VIEW {} WITH (action=transform, outputfunc=insert_into_stream('o')) AS SELECT x FROM s", "transform into nothing": "CREATE VIEW {} WITH (action=transform, outputfunc=insert_into_stream('zz')) AS SELECT y FROM s",
    "reading a stream": "SELECT * FROM s", "combine of two columns": "SELECT combine(n, n) FROM v", "combine of a key": "SELECT combine(x) FROM v", "combine of a table": "SELECT combine(x) FROM range(3)", "combine in combine": "SELECT combine(combine(n)) FROM v", "ttl_expire without ttl": "SELECT ttl_expire('v')", "activate unknown": "SELECT activate('zz')", "deactivate unknown": "SELECT deactivate('zz')",
    "insert into nothing": "INSERT INTO zz VALUES (1)", "unknown column": "INSERT INTO s (zz) VALUES (1)", "too many values": "INSERT INTO s (x) VALUES (1, 2)", "name taken": "CREATE VIEW v AS SELECT x FROM s", "reserved column": "CREATE STREAM zz (arrival_timestamp timestamptz)", "reserved target": "CREATE VIEW {} AS SELECT x AS _batch FROM s",
}


@query(_values(*_REFUSED))
def refusals(spark, d):
    """Statements that can't be continuous queries, or not of these names, each refused."""
    e = Engine(spark, clock=lambda: AS_OF)
    for text in ("CREATE STREAM s (x integer, y text)", "CREATE STREAM o (y text)", "CREATE VIEW v AS SELECT x, count(*) AS n FROM s GROUP BY x", "INSERT INTO s VALUES (1, 'a')"):
        SQL.run(e, text)
    before = {*e.streams, *e.queries}
    out = {name: _fails(lambda text=text, i=i: SQL.run(e, text.format(f"r{i}"))) for i, (name, text) in enumerate(_REFUSED.items())}
    return _checked(spark, {n: ok and {*e.streams, *e.queries} == before for n, ok in out.items()})


@query("SELECT event_type, string_agg(DISTINCT (user_id % 5)::VARCHAR, ',' ORDER BY (user_id % 5)::VARCHAR) AS kinds, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def sql_set_aggregates(spark, d):
    """Sets and exact distinct counts by SQL, read twice and combined over all groups."""
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, user_id % 5 AS k, set_agg(user_id % 5) AS kinds, exact_count_distinct(user_id) AS users FROM events GROUP BY event_type, user_id % 5")
    out = SQL.run(e, "SELECT event_type, combine(kinds) AS kinds, combine(users) AS users FROM v GROUP BY event_type")
    return out.select("event_type", joined(F.array_sort("kinds")).alias("kinds"), "users")
