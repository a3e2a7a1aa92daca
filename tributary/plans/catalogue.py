"""All queries of the engine by name, with their DuckDB equivalents.

Most fold a table into a view in three batches and read it; the SQL says what the whole table gives at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sketches as S
from ..functions.time import date_round, hash_group, ls_hash_group, truncated
from ..operators import aggregates as A
from . import sql as SQL
from .engine import Engine
from .view import View, cube, rollup

AS_OF = dt.datetime(2024, 1, 31)
BATCHES = 3
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def batches(df: DataFrame, split: str) -> list[DataFrame]:
    """Every row in one batch; those without a key to split by are in the first."""
    return [df.where(f"pmod(coalesce({split}, 0), {BATCHES}) = {i}") for i in range(BATCHES)]


def folded(spark: SparkSession, d: str, source: str = "events", split: str = "event_id", **options) -> View:
    view = View("v", **options)
    for b in batches(table(spark, d, source), split):
        view.ingest(b, as_of=AS_OF if view.window else None)
    return view


def rows(spark: SparkSession, d: str, source: str = "events", split: str = "event_id", **options) -> DataFrame:
    view = folded(spark, d, source, split, **options)
    return view.read(AS_OF if view.window else None)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


TYPE = {"event_type": "event_type"}


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users, min(value) AS least, max(value) AS most,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """By type of event: counts, sums, means, distinct users, extremes and exact quantiles, folded from three batches."""
    aggs = {"n": A.count(), "total": A.sum_("value"), "mean": A.avg("value"), "users": A.exact_count_distinct("user_id"), "least": A.min_("value"), "most": A.max_("value"), "p": A.percentile_cont([0.5, 0.99], "value", exact=True)}
    out = rounded(rounded(rows(spark, d, keys=TYPE, aggs=aggs), "total"), "mean", digits=6)
    return out.select("event_type", "n", "total", "mean", "users", "least", "most", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p99"))


# counts, sums, extremes


@query("SELECT event_type, count(*) AS n, count(value) AS n_value FROM events GROUP BY event_type")
def cv_count(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"n": A.count(), "n_value": A.count("value")})


@query("SELECT event_type, round(sum(value), 4) AS total, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def cv_sum(spark, d):
    return rounded(rows(spark, d, keys=TYPE, aggs={"total": A.sum_("value"), "users": A.sum_("user_id")}), "total")


@query("SELECT event_type, round(avg(value), 4) AS mean, round(avg(user_id), 4) AS mean_user FROM events GROUP BY event_type")
def cv_avg(spark, d):
    return rounded(rows(spark, d, keys=TYPE, aggs={"mean": A.avg("value"), "mean_user": A.avg("user_id")}), "mean", "mean_user")


@query("SELECT event_type, min(value) AS lo, max(value) AS hi, min(ts) AS first_ts, max(props) AS last_props FROM events GROUP BY event_type")
def cv_minmax(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"lo": A.min_("value"), "hi": A.max_("value"), "first_ts": A.min_("ts"), "last_props": A.max_("props")})


@query("SELECT event_type, bool_and(value > 1) AS all_high, bool_or(value > 400) AS any_high, bool_and(user_id >= 0) AS every_user, bit_and(user_id) AS ba, bit_or(user_id) AS bo FROM events GROUP BY event_type")
def cv_bool_bit(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"all_high": A.bool_and("value > 1"), "any_high": A.bool_or("value > 400"), "every_user": A.every("user_id >= 0"), "ba": A.bit_and("user_id"), "bo": A.bit_or("user_id")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS price, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def cv_lineitem(spark, d):
    aggs = {"n": A.count(), "qty": A.sum_("l_quantity"), "price": A.sum_("l_extendedprice * (1 - l_discount)"), "disc": A.avg("l_discount")}
    out = rows(spark, d, "lineitem", "l_orderkey", keys={"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, aggs=aggs, where="l_shipdate <= timestamp_ntz'2001-09-02 00:00:00'")
    return rounded(rounded(rounded(out, "qty", digits=2), "price"), "disc", digits=6)


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def cv_global(spark, d):
    return rounded(rows(spark, d, aggs={"n": A.count(), "total": A.sum_("value")}), "total")


@query("SELECT event_type, round(var_pop(value), 4) AS vp, round(var_samp(value), 4) AS vs, round(stddev_pop(value), 4) AS sp, round(stddev_samp(value), 4) AS ss, round(var_samp(user_id), 4) AS vu FROM events GROUP BY event_type")
def cv_stats(spark, d):
    aggs = {"vp": A.var_pop("value", shift=40.0), "vs": A.var_samp("value"), "sp": A.stddev_pop("value"), "ss": A.stddev_samp("value"), "vu": A.var_samp("user_id", exact=True)}
    return rounded(rows(spark, d, keys=TYPE, aggs=aggs), *aggs)


@query("""SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_extendedprice, l_quantity), 6) AS co, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs,
round(regr_sxy(l_extendedprice, l_quantity) / 1000, 2) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e9, 3) AS syy FROM lineitem GROUP BY l_returnflag""")
def cv_regr(spark, d):
    a = ("l_extendedprice", "l_quantity")
    aggs = {"n": A.regr_count(*a), "ax": A.regr_avgx(*a), "ay": A.regr_avgy(*a), "sxx": A.regr_sxx(*a), "slope": A.regr_slope(*a), "icept": A.regr_intercept(*a), "r2": A.regr_r2(*a), "co": A.corr(*a), "cp": A.covar_pop(*a), "cs": A.covar_samp(*a), "sxy": A.regr_sxy(*a), "syy": A.regr_syy(*a)}
    out = rows(spark, d, "lineitem", "l_orderkey", keys={"l_returnflag": "l_returnflag"}, aggs=aggs)
    digits = {"ax": 4, "ay": 4, "sxx": 2, "slope": 4, "icept": 3, "r2": 6, "co": 6, "cp": 3, "cs": 3}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()} | {"sxy": F.round(F.col("sxy") / 1000, 2), "syy": F.round(F.col("syy") / 1e9, 3)})


# the shape of a view


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE user_id < 20), 4) AS some, round(avg(value) FILTER (WHERE value > 1000), 4) AS none FROM events GROUP BY event_type")
def cv_filter(spark, d):
    aggs = {"high": A.count().where("value > 50"), "some": A.sum_("value").where("user_id < 20"), "none": A.avg("value").where("value > 1000")}
    return rounded(rows(spark, d, keys=TYPE, aggs=aggs), "some", "none")


@query("SELECT user_id % 10 AS g, round(sum(value) / count(*) + max(value), 4) AS mixed, 'x' AS tag FROM events WHERE value > 2 GROUP BY g")
def cv_expr_over_aggs(spark, d):
    out = rows(spark, d, keys={"g": "user_id % 10"}, aggs={"s": A.sum_("value"), "n": A.count(), "m": A.max_("value")}, outputs={"g": "g", "mixed": "s / n + m", "tag": "'x'"}, where="value > 2")
    return rounded(out, "mixed")


@query("SELECT DISTINCT event_type, user_id FROM events")
def cv_distinct(spark, d):
    return rows(spark, d, keys={"event_type": "event_type", "user_id": "user_id"}, distinct=True)


@query("SELECT user_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, props) AS r FROM events) WHERE r = 1")
def cv_distinct_on(spark, d):
    return rows(spark, d, keys={"user_id": "user_id", "event_type": "event_type", "props": "props"}, distinct_on=["user_id"], order_by=["event_type", "props"])


@query("SELECT event_id, upper(event_type) AS kind, value * 2 AS twice FROM events WHERE value > 100")
def cv_projection(spark, d):
    return rows(spark, d, keys={"event_id": "event_id", "kind": "upper(event_type)", "twice": "value * 2"}, where="value > 100")


@query("SELECT event_type, (user_id % 3)::VARCHAR AS u, grouping_id(event_type, user_id % 3)::BIGINT AS grouping_id, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cv_cube(spark, d):
    return rounded(rows(spark, d, keys=TYPE | {"u": "CAST(user_id % 3 AS string)"}, aggs={"n": A.count(), "s": A.sum_("value")}, grouping_sets=cube("event_type", "u")), "s")


@query("SELECT event_type, (user_id % 3)::VARCHAR AS u, grouping_id(event_type, user_id % 3)::BIGINT AS grouping_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def cv_rollup(spark, d):
    return rows(spark, d, keys=TYPE | {"u": "CAST(user_id % 3 AS string)"}, aggs={"n": A.count()}, grouping_sets=rollup("event_type", "u"))


@query("SELECT event_type, (user_id % 3)::VARCHAR AS u, grouping_id(event_type, user_id % 3)::BIGINT AS grouping_id, count(DISTINCT user_id) AS users FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), ())")
def cv_grouping_sets(spark, d):
    return rows(spark, d, keys=TYPE | {"u": "CAST(user_id % 3 AS string)"}, aggs={"users": A.exact_count_distinct("user_id")}, grouping_sets=[["event_type"], ["u"], []])


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 5")
def cv_limit_overlay(spark, d):
    return rows(spark, d, keys={"user_id": "user_id"}, aggs={"n": A.count()}, order_by=[F.desc("n"), "user_id"], limit=10, offset=5)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id, event_type LIMIT 7")
def cv_top_groups(spark, d):
    out = rows(spark, d, keys={"user_id": "user_id"} | TYPE, aggs={"n": A.count()})
    return out.orderBy(F.desc("n"), "user_id", "event_type").limit(7)


@query("SELECT kind, count(*) AS n FROM (SELECT upper(event_type) AS kind, value FROM (SELECT event_type, value FROM events WHERE value > 5) WHERE value < 90) GROUP BY kind")
def cv_subselect(spark, d):
    inner = lambda b: b.where("value > 5").select("event_type", "value").where("value < 90").selectExpr("upper(event_type) AS kind", "value")
    return rows(spark, d, prepare=inner, keys={"kind": "kind"}, aggs={"n": A.count()})


@query("SELECT i, count(*) AS n FROM (SELECT unnest(range(0, user_id % 4 + 1)) AS i FROM events) GROUP BY i")
def cv_fan_out(spark, d):
    return rows(spark, d, prepare=lambda b: b.select(F.explode(F.expr("sequence(0L, user_id % 4)")).alias("i")), keys={"i": "i"}, aggs={"n": A.count()})


# joins of a stream with tables


def _join_view(spark, d, how: str, keys, aggs, table_: str = "customer", **more):
    t = table(spark, d, table_)
    return rows(spark, d, "orders", "o_orderkey", prepare=lambda b: b.join(t, b["o_custkey"] == t["c_custkey"], how), keys=keys, aggs=aggs, **more)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_inner(spark, d):
    return rounded(_join_view(spark, d, "inner", {"c_mktsegment": "c_mktsegment"}, {"n": A.count(), "total": A.sum_("o_totalprice")}), "total", digits=2)


@query("SELECT c_mktsegment, count(*) AS n, count(c_custkey) AS matched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_left(spark, d):
    t = table(spark, d, "customer").where("c_acctbal > 0")
    return rows(spark, d, "orders", "o_orderkey", prepare=lambda b: b.join(t, b["o_custkey"] == t["c_custkey"], "left"), keys={"c_mktsegment": "c_mktsegment"}, aggs={"n": A.count(), "matched": A.count("c_custkey")})


@query("SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS matched FROM (SELECT *, o_orderkey % 3 AS b FROM orders) o RIGHT JOIN (SELECT *, unnest(range(3)) AS b FROM customer) c ON o_custkey = c_custkey AND o.b = c.b GROUP BY c_mktsegment")
def join_right(spark, d):
    """Each of the three batches keeps all customers; orders without a key are in none of them."""
    t = table(spark, d, "customer")
    prepare = lambda b: b.where("o_orderkey IS NOT NULL").join(t, b["o_custkey"] == t["c_custkey"], "right")
    return rows(spark, d, "orders", "o_orderkey", prepare=prepare, keys={"c_mktsegment": "c_mktsegment"}, aggs={"n": A.count(), "matched": A.count("o_orderkey")})


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) GROUP BY o_orderpriority")
def join_semi(spark, d):
    t = table(spark, d, "customer").where("c_acctbal > 5000")
    return rows(spark, d, "orders", "o_orderkey", prepare=lambda b: b.join(t, b["o_custkey"] == t["c_custkey"], "left_semi"), keys={"o_orderpriority": "o_orderpriority"}, aggs={"n": A.count()})


@query("SELECT o_orderpriority, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey WHERE c_custkey IS NULL GROUP BY o_orderpriority")
def join_anti(spark, d):
    t = table(spark, d, "customer").where("c_acctbal > 5000")
    return rows(spark, d, "orders", "o_orderkey", prepare=lambda b: b.join(t, b["o_custkey"] == t["c_custkey"], "left_anti"), keys={"o_orderpriority": "o_orderpriority"}, aggs={"n": A.count()})


@query("SELECT r_name, event_type, count(*) AS n FROM events CROSS JOIN region GROUP BY ALL")
def join_cross(spark, d):
    return rows(spark, d, prepare=lambda b: b.crossJoin(table(spark, d, "region")), keys={"r_name": "r_name"} | TYPE, aggs={"n": A.count()})


@query("SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_multi(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    prepare = lambda b: b.join(c, b["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rounded(rows(spark, d, "orders", "o_orderkey", prepare=prepare, keys={"r_name": "r_name", "n_name": "n_name"}, aggs={"n": A.count(), "total": A.sum_("o_totalprice")}), "total", digits=2)


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT *, o_custkey AS k FROM orders) JOIN (SELECT c_custkey AS k, c_acctbal FROM customer) USING (k) WHERE c_acctbal < 0 GROUP BY o_orderstatus")
def join_using(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return rows(spark, d, "orders", "o_orderkey", prepare=lambda b: b.withColumn("k", F.col("o_custkey")).join(t, ["k"]), where="c_acctbal < 0", keys={"o_orderstatus": "o_orderstatus"}, aggs={"n": A.count()})


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > p_size GROUP BY p_brand")
def join_theta(spark, d):
    t = table(spark, d, "part")
    return rows(spark, d, "lineitem", "l_orderkey", prepare=lambda b: b.join(t, (b["l_partkey"] == t["p_partkey"]) & (b["l_quantity"] > t["p_size"])), keys={"p_brand": "p_brand"}, aggs={"n": A.count()})


@query("WITH v AS (SELECT o_custkey, count(*) AS orders_ FROM orders GROUP BY o_custkey) SELECT event_type, sum(orders_)::BIGINT AS s, count(*) AS n FROM events JOIN v ON user_id = o_custkey GROUP BY event_type")
def join_with_view(spark, d):
    v = rows(spark, d, "orders", "o_orderkey", keys={"o_custkey": "o_custkey"}, aggs={"orders_": A.count()})
    return rows(spark, d, prepare=lambda b: b.join(v, b["user_id"] == v["o_custkey"]), keys=TYPE, aggs={"s": A.sum_("orders_"), "n": A.count()})


@query("SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-21' GROUP BY c_mktsegment")
def join_sliding(spark, d):
    t = table(spark, d, "customer")
    return rows(spark, d, prepare=lambda b: b.join(t, b["user_id"] == t["c_custkey"]), keys={"c_mktsegment": "c_mktsegment"}, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")


# time


_IN = "time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-21'"


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {_IN} GROUP BY event_type")
def sw_count(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")


@query(f"SELECT event_type, round(avg(value), 4) AS mean, round(sum(value), 4) AS total, max(value) AS hi, round(stddev_samp(value), 4) AS sd, bool_or(value > 400) AS big FROM events WHERE {_IN} GROUP BY event_type")
def sw_avg(spark, d):
    aggs = {"mean": A.avg("value"), "total": A.sum_("value"), "hi": A.max_("value"), "sd": A.stddev_samp("value"), "big": A.bool_or("value > 400")}
    return rounded(rows(spark, d, keys=TYPE, aggs=aggs, sliding_window="10 days", time_column="ts"), "mean", "total", "sd")


@query(f"SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE {_IN} GROUP BY event_type")
def sw_distinct_users(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"users": A.exact_count_distinct("user_id")}, sliding_window="10 days", time_column="ts")


@query("SELECT event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') > TIMESTAMP '2024-01-26' GROUP BY event_type")
def sw_narrower(spark, d):
    return folded(spark, d, keys=TYPE, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts").read(AS_OF, "5 days")


@query("SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-28'")
def sw_rows(spark, d):
    return rows(spark, d, keys={"event_id": "event_id", "value": "value"}, sliding_window="3 days", time_column="ts")


@query("""WITH b AS (SELECT event_type, user_id, value, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') AS b FROM events),
o AS (SELECT user_id, count(*) AS n FROM b WHERE b > TIMESTAMP '2024-01-21' GROUP BY user_id), w AS (SELECT user_id, count(*) AS n FROM b WHERE b > TIMESTAMP '2024-01-26' GROUP BY user_id)
SELECT o.user_id AS user_id, o.n AS old_n, w.n AS new_n FROM o LEFT JOIN w ON o.user_id = w.user_id WHERE o.n IS DISTINCT FROM w.n""")
def sw_tick_changes(spark, d):
    view = folded(spark, d, keys={"user_id": "user_id"}, aggs={"n": A.count()}, sliding_window="10 days", time_column="ts")
    view.tick(AS_OF)
    change = view.tick(AS_OF + dt.timedelta(days=5))
    return change.select(F.coalesce("old.user_id", "new.user_id").alias("user_id"), F.col("old.n").alias("old_n"), F.col("new.n").alias("new_n"))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY day HAVING date_trunc('day', ts) > TIMESTAMP '2024-01-20'")
def ttl_expire(spark, d):
    view = folded(spark, d, keys={"day": truncated("day", "ts")}, aggs={"n": A.count()}, ttl="11 days", ttl_column="day")
    view.expire(AS_OF)
    return view.read()


@query("SELECT event_id, time_bucket(INTERVAL '10 seconds', ts, TIMESTAMP '2000-01-01') AS s10, time_bucket(INTERVAL '7 hours', ts, TIMESTAMP '2000-01-01') AS h7, time_bucket(INTERVAL '60 days', ts, TIMESTAMP '2000-01-01') AS m2 FROM events")
def date_rounding(spark, d):
    return table(spark, d, "events").select("event_id", date_round("ts", "10 seconds").alias("s10"), date_round("ts", "7 hours").alias("h7"), date_round("ts", "2 months").alias("m2"))


@query("SELECT event_id, " + ", ".join(f"date_trunc('{u}', ts)::TIMESTAMP AS t_{u}" for u in ("year", "month", "day", "hour", "minute", "second")) + " FROM events")
def date_truncation(spark, d):
    return table(spark, d, "events").select("event_id", *[truncated(u, "ts").cast("timestamp_ntz").alias(f"t_{u}") for u in ("year", "month", "day", "hour", "minute", "second")])


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
def tumbling(spark, d):
    return rounded(rows(spark, d, keys={"start": date_round("ts", "6 hours")} | TYPE, aggs={"n": A.count(), "s": A.sum_("value")}), "s")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS same FROM events")
def group_hashes(spark, d):
    """Equal groups hash alike and different ones here don't; hashes near in time are near."""
    e = table(spark, d, "events").select(hash_group("user_id").alias("h"), ls_hash_group("ts", "event_id").alias("l"))
    return e.agg(F.count("l").alias("n"), F.count_distinct("h").alias("same"))


# combining states


@query("SELECT user_id % 2 AS g, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY g")
def combine_states(spark, d):
    aggs = {"n": A.count(), "mean": A.avg("value"), "sd": A.stddev_samp("value"), "lo": A.min_("value"), "hi": A.max_("value")}
    view = folded(spark, d, keys={"user_id": "user_id"}, aggs=aggs)
    return rounded(view.combine(list(aggs), {"g": "user_id % 2"}), "mean", "sd")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id > 5 GROUP BY event_type HAVING count(*) > 1900")
def combine_having(spark, d):
    return folded(spark, d, keys={"user_id": "user_id"} | TYPE, aggs={"n": A.count()}).combine(["n"], ["event_type"], where="user_id > 5", having="n > 1900")


@query("SELECT count(DISTINCT user_id) AS users, round(corr(value, user_id), 6) AS co, count(*) AS n FROM events")
def combine_all(spark, d):
    view = folded(spark, d, keys=TYPE, aggs={"users": A.exact_count_distinct("user_id"), "co": A.corr("value", "user_id"), "n": A.count()})
    return rounded(view.combine(["users", "co", "n"]), "co", digits=6)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def merge_tables_of_states(spark, d):
    options = dict(keys=TYPE, aggs={"n": A.count(), "s": A.sum_("value")})
    a, b = View("a", **options), View("b", **options)
    one, *rest = batches(table(spark, d, "events"), "event_id")
    a.ingest(one)
    for x in rest:
        b.ingest(x)
    a.merge_state(b.state())
    return rounded(a.read(), "s")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 = 2 GROUP BY event_type")
def truncate_view(spark, d):
    view = View("v", keys=TYPE, aggs={"n": A.count()})
    parts = batches(table(spark, d, "events"), "event_id")
    for i, b in enumerate(parts):
        if i == 2:
            view.truncate()
        view.ingest(b)
    return view.read()


# collections and distinct counts


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN user_id > 9 THEN user_id END) + 1 AS with_null FROM events GROUP BY event_type")
def exact_distinct(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"users": A.exact_count_distinct("user_id"), "with_null": A.exact_count_distinct("CASE WHEN user_id > 9 THEN user_id END")})


@query("SELECT event_type, (SELECT string_agg(x, ',' ORDER BY x::INT) FROM (SELECT DISTINCT user_id::VARCHAR AS x FROM events b WHERE b.event_type = a.event_type)) AS users FROM (SELECT DISTINCT event_type FROM events) a")
def set_agg(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"users": A.set_agg("user_id", ordered=True)}).withColumn("users", joined("users"))


@query("SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def array_agg(spark, d):
    return rows(spark, d, keys={"user_id": "user_id"}, aggs={"ids": A.array_agg("event_id", ordered=True)}).select("user_id", F.size("ids").cast("long").alias("n"), joined("ids").alias("ids"))


@query("SELECT conv_id, string_agg(role, '/' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def string_agg(spark, d):
    return rows(spark, d, "conversations", "conv_id", keys={"conv_id": "conv_id"}, aggs={"roles": A.string_agg("role", "/", ordered=True)})


@query("SELECT user_id, '[' || string_agg('\"' || event_type || '\"', ',' ORDER BY event_type) || ']' AS types FROM events GROUP BY user_id")
def json_agg(spark, d):
    return rows(spark, d, keys={"user_id": "user_id"}, aggs={"types": A.json_agg("event_type", ordered=True)})


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS nations FROM nation GROUP BY n_regionkey")
def json_object_agg(spark, d):
    return rows(spark, d, "nation", "n_nationkey", keys={"n_regionkey": "n_regionkey"}, aggs={"nations": A.jsonb_object_agg("n_name", "n_nationkey")})


@query("SELECT event_type, '{\"k\":' || sum(CAST(props->>'$.k' AS BIGINT))::BIGINT || '}' AS sums FROM events GROUP BY event_type")
def json_object_int_sum(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"sums": A.json_object_int_sum("props")})


@query("SELECT event_type, true AS close FROM (SELECT DISTINCT event_type FROM events)")
def hll_tolerance(spark, d):
    """The distinct-count sketch against the exact count: within 2 percent."""
    out = rows(spark, d, keys=TYPE, aggs={"a": A.count_distinct("event_id"), "e": A.count()})
    return out.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.02 * F.col("e")).alias("close"))


@query("SELECT true AS close, 0::BIGINT AS of_null")
def hll_functions_tolerance(spark, d):
    """Sketches stored, united by scalar and by aggregate, and counted."""
    out = rows(spark, d, keys={"g": "user_id % 2"}, aggs={"h": A.hll_agg("event_id")})
    both = out.agg(A.hll_union_agg("h").parts[0].make(lambda c: c).alias("u"), F.max_by("h", "g").alias("a"), F.min_by("h", "g").alias("b"))
    n = table(spark, d, "events").agg(F.count_distinct("event_id").alias("n"))
    close = lambda c: F.abs(S.hll_cardinality(c) - F.col("n")) <= 0.02 * F.col("n")
    return both.crossJoin(n).select((close(F.col("u")) & close(S.hll_union("a", "b"))).alias("close"), S.hll_cardinality(F.lit(None).cast("binary")).alias("of_null"))


@query("SELECT event_type, true AS all_in, true AS few_false, true AS close FROM (SELECT DISTINCT event_type FROM events)")
def bloom_tolerance(spark, d):
    """Membership of every value added, of as many that were not (5 percent at most), and the estimated number."""
    t = table(spark, d, "events")
    size = max(S.BLOOM_N, t.groupBy("event_type").count().agg(F.max("count")).first()[0] or 0)
    v = rows(spark, d, keys=TYPE, aggs={"b": A.bloom_agg("event_id", n=size), "n": A.count()})
    blocks = v.select(F.col("event_type").alias("t"), F.explode("b").alias("e")).select("t", "e.k", "e.v")
    probe = t.select("event_type", F.posexplode(F.expr("array(event_id, event_id + 100000000000L)")).alias("wrong", "x")).withColumn("at", S.bloom_block(F.col("x"), n=size))
    hit = probe.join(blocks, F.col("event_type").eqNullSafe(F.col("t")) & (F.col("at") == F.col("k")), "left").select("event_type", "wrong", S.bloom_hit(F.col("v"), F.col("x"), n=size).alias("hit"))
    per = hit.groupBy("event_type").agg(F.bool_and(F.col("hit") | (F.col("wrong") == 1)).alias("all_in"), (F.count_if(F.col("hit") & (F.col("wrong") == 1)) <= 0.05 * F.count_if(F.col("wrong") == 1)).alias("few_false"))
    close = v.select(F.col("event_type").alias("t"), (F.abs(S.bloom_cardinality("b", n=size) - F.col("n")) <= 0.05 * F.col("n")).alias("close"))
    return per.join(close, per["event_type"].eqNullSafe(close["t"])).select("event_type", "all_in", "few_false", "close")


@query("SELECT true AS either, true AS neither, true AS fewer")
def bloom_sets_tolerance(spark, d):
    """The union of two filters has what either has; their intersection what both have and hardly more."""
    t = table(spark, d, "events")
    size = max(S.BLOOM_N, t.count())
    v = View("v", keys={"g": "1"}, aggs={"a": A.bloom_agg("event_id", n=size).where("event_id % 2 = 0"), "b": A.bloom_agg("event_id", n=size).where("event_id % 3 = 0")})
    for b in batches(t, "event_id"):
        v.ingest(b)
    two = v.read().select(F.explode(F.array("a", "b")).alias("x"))
    sets = View("s", aggs={"u": A.bloom_union_agg("x"), "i": A.bloom_intersection_agg("x")})
    sets.ingest(two)
    bits = sets.read().select(F.posexplode(F.array("u", "i")).alias("s", "b")).select("s", F.explode("b").alias("e"))
    blocks = bits.groupBy("e.k").agg(*[F.max(F.when(F.col("s") == i, F.col("e.v"))).alias(c) for i, c in enumerate("ui")])
    e = t.select("event_id", S.bloom_block(F.col("event_id"), n=size).alias("at")).join(blocks, F.col("at") == F.col("k"), "left")
    both, any_ = "event_id % 6 = 0", "(event_id % 2 = 0 OR event_id % 3 = 0)"
    hit_u, hit_i = (S.bloom_hit(F.col(c), F.col("event_id"), n=size) for c in ("u", "i"))
    return e.select(hit_u.alias("hu"), hit_i.alias("hi"), F.expr(both).alias("both"), F.expr(any_).alias("any")).agg(F.bool_and(~F.col("any") | F.col("hu")).alias("either"), F.bool_and(~F.col("both") | F.col("hi")).alias("neither"), (F.count_if(F.col("hi") & ~F.col("both")) <= 0.1 * F.count("*")).alias("fewer"))


@query("SELECT event_type, string_agg(user_id || ':' || n, ',' ORDER BY n DESC, user_id) AS top FROM (SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 5 GROUP BY event_type")
def topk(spark, d):
    out = rows(spark, d, keys=TYPE, aggs={"t": A.topk_agg("user_id", 5, weight="1")})
    return out.select("event_type", F.array_join(F.transform("t", lambda e: F.concat_ws(":", e["item"].cast("string"), e["count"].cast("string"))), ",").alias("top"))


@query("SELECT event_type, string_agg(user_id || ':' || w, ',' ORDER BY w DESC, user_id) AS top FROM (SELECT event_type, user_id, w, row_number() OVER (PARTITION BY event_type ORDER BY w DESC, user_id) AS r FROM (SELECT event_type, user_id, sum(event_id % 7)::BIGINT AS w FROM events GROUP BY ALL)) WHERE r <= 3 GROUP BY event_type")
def topk_weighted(spark, d):
    out = rows(spark, d, keys=TYPE, aggs={"t": A.topk_agg("user_id", 3, weight="event_id % 7")})
    return out.select("event_type", F.array_join(F.transform("t", lambda e: F.concat_ws(":", e["item"].cast("string"), e["count"].cast("string"))), ",").alias("top"))


@query("SELECT event_type, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS freqs FROM (SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 5 GROUP BY event_type")
def topk_sketch(spark, d):
    """By counts of all items: a sketch is sure of none where there are many more values than it holds."""
    return rows(spark, d, keys=TYPE, aggs={"t": A.topk_agg("user_id", 5)}).select("event_type", joined(S.topk_freqs("t")).alias("freqs"))


@query("SELECT event_type, min(value) AS q0, max(value) AS q1, true AS close FROM events GROUP BY event_type")
def dist_tolerance(spark, d):
    """Quantiles and shares by the sketch within half a percent of the ranks; least and greatest exactly."""
    v = rows(spark, d, keys=TYPE, aggs={"t": A.dist_agg("value")})
    asked = (0.01, 0.5, 0.99)
    v = v.select(F.col("event_type").alias("type"), *[S.dist_quantile("t", q).alias(f"v{i}") for i, q in enumerate(asked)], S.dist_quantile("t", 0).alias("q0"), S.dist_quantile("t", 1).alias("q1"), S.dist_cdf("t", "20.0D").alias("cdf"))
    e = table(spark, d, "events").select("event_type", "value")
    close = F.abs(F.avg((F.col("value") <= 20).cast("double")) - F.max("cdf")) <= 0.005
    for i, q in enumerate(asked):
        close = close & (F.avg((F.col("value") <= F.col(f"v{i}")).cast("double")) >= q - 0.005) & (F.avg((F.col("value") < F.col(f"v{i}")).cast("double")) <= q + 0.005)
    return e.join(v, e["event_type"] == v["type"]).groupBy("event_type").agg(F.max("q0").alias("q0"), F.max("q1").alias("q1"), close.alias("close"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_cont(spark, d):
    out = rows(spark, d, keys=TYPE, aggs={"p": A.percentile_cont([0.5, 0.99], "value", exact=True)})
    return rounded(out.select("event_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p99")), "p50", "p99", digits=6)


@query("SELECT true AS upper, true AS close, (SELECT count(*) FROM events) AS total, 0::BIGINT AS of_null")
def freq_tolerance(spark, d):
    """Counts by the count-min sketch: never too small, and too large by 0.2 percent of all at most."""
    v = View("v", aggs={"f": A.freq_agg("user_id")})
    for b in batches(table(spark, d, "events"), "event_id"):
        v.ingest(b)
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    # as S.freq, but cells are joined: it would build a map of the whole sketch for each user
    cells = v.read().select(F.explode("f").alias("c")).select("c.k", "c.v")
    asked = per.select("user_id", "n", F.explode(F.array(*S.cms_cells(F.col("user_id"), S.CMS_EPS, S.CMS_P))).alias("at"))
    found = asked.join(F.broadcast(cells), F.col("at") == F.col("k"), "left").groupBy("user_id").agg(F.max("n").alias("n"), F.min(F.when(F.col("user_id").isNotNull(), F.coalesce("v", F.lit(0)))).alias("f"))
    whole = v.read().select(S.freq_total("f").alias("total"), S.freq("f", F.lit(None).cast("bigint")).alias("of_null"))
    f, n = F.coalesce("f", F.lit(0)), F.col("n")
    return found.crossJoin(F.broadcast(whole)).agg(F.bool_and(f >= n).alias("upper"), F.bool_and(f <= n + 0.002 * F.col("total")).alias("close"), F.max("total").alias("total"), F.max("of_null").alias("of_null"))


# ranks, keyed values, first values, buckets


@query("""SELECT event_type, 1 + count(*) FILTER (WHERE value < 20) AS rk, count(*) FILTER (WHERE value < 20) / count(*) AS pr, (1 + count(*) FILTER (WHERE value <= 20)) / (count(*) + 1) AS cd,
1 + count(DISTINCT user_id) FILTER (WHERE user_id < 70) AS dr, 1 + count(*) FILTER (WHERE user_id < 70 OR (user_id = 70 AND value < 20)) AS rk2 FROM events GROUP BY event_type""")
def hypothetical_sets(spark, d):
    aggs = {"rk": A.rank(20.0, "value"), "pr": A.percent_rank(20.0, "value"), "cd": A.cume_dist(20.0, "value"), "dr": A.dense_rank(70, "user_id", exact=True), "rk2": A.rank([70, 20.0], ["user_id", "value"])}
    return rows(spark, d, keys=TYPE, aggs=aggs)


@query("SELECT event_type, true AS close FROM (SELECT DISTINCT event_type FROM events)")
def dense_rank_tolerance(spark, d):
    out = rows(spark, d, keys=TYPE, aggs={"a": A.dense_rank(5000, "event_id"), "e": A.dense_rank(5000, "event_id", exact=True)})
    return out.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.04 * F.col("e")).alias("close"))


@query("SELECT event_type, arg_min(user_id, ts) AS first_user, arg_max(user_id, ts) AS last_user, arg_max(props, event_id) AS last_props FROM events GROUP BY event_type")
def keyed_min_max(spark, d):
    return rows(spark, d, keys=TYPE, aggs={"first_user": A.keyed_min("ts", "user_id"), "last_user": A.keyed_max("ts", "user_id"), "last_props": A.keyed_max("event_id", "props")})


@query("SELECT event_type, string_agg(value::VARCHAR, ',' ORDER BY value, event_id) AS least, string_agg(value || '/' || event_id, ',' ORDER BY value, event_id) AS both FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r <= 4 GROUP BY event_type")
def first_values(spark, d):
    out = rows(spark, d, keys=TYPE, aggs={"least": A.first_values(4, "value"), "both": A.first_values(4, "value", "event_id")})
    return out.select("event_type", joined("least").alias("least"), F.array_join(F.transform("both", lambda e: F.concat_ws("/", e["c0"].cast("string"), e["c1"].cast("string"))), ",").alias("both"))


@query("SELECT string_agg(s || ':' || n, ',' ORDER BY s) AS sets, max(n) FILTER (WHERE s = 3) AS third FROM (SELECT s, count(*) AS n FROM (SELECT user_id, arg_max(event_id % 5, event_id) AS s FROM events GROUP BY user_id) GROUP BY s)")
def bucket_agg(spark, d):
    out = rows(spark, d, aggs={"b": A.bucket_agg("user_id", "event_id % 5", "timestamp_seconds(event_id)")})
    pairs = F.zip_with(S.bucket_ids("b"), S.bucket_cardinalities("b"), lambda i, n: F.concat_ws(":", i.cast("string"), n.cast("string")))
    return out.select(F.array_join(pairs, ",").alias("sets"), S.bucket_cardinality("b", "3").alias("third"))


# over views, and between them


@query("SELECT day, n, round(avg(n) OVER w, 4) AS ahead, first_value(n) OVER w AS this FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY day) WINDOW w AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)")
def overlay_window(spark, d):
    """One row a day, so the window's single partition has as many rows as there are days."""
    v = rows(spark, d, keys={"day": truncated("day", "ts").cast("timestamp_ntz")}, aggs={"n": A.count()})
    w = Window.orderBy("day").rowsBetween(0, 5)
    return v.select("day", "n", F.round(F.avg("n").over(w), 4).alias("ahead"), F.first("n").over(w).alias("this"))


@query("SELECT 'type' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM events GROUP BY user_id")
def union_of_views(spark, d):
    a = rows(spark, d, keys={"name": "event_type"}, aggs={"n": A.count()}).select(F.lit("type").alias("kind"), "name", "n")
    b = rows(spark, d, keys={"name": "CAST(user_id AS string)"}, aggs={"n": A.count()}).select(F.lit("user").alias("kind"), "name", "n")
    return a.unionByName(b)


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND value > 100")
def set_operations(spark, d):
    of = lambda c: rows(spark, d, keys={"user_id": "user_id"}, distinct=True, where=c)
    return of("event_type = 'click'").intersect(of("event_type = 'error'")).subtract(of("event_type = 'view' AND value > 100"))


@query("""WITH o AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY user_id), w AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 2 GROUP BY user_id)
SELECT w.user_id AS user_id, o.n AS old_n, w.n AS new_n, b.n AS delta_n FROM b JOIN w ON w.user_id = b.user_id LEFT JOIN o ON o.user_id = b.user_id""")
def output_stream_changes(spark, d):
    """What the last of three batches changes."""
    view, change = View("v", keys={"user_id": "user_id"}, aggs={"n": A.count()}), None
    for b in batches(table(spark, d, "events"), "event_id"):
        change = view.ingest(b, changes=True)
    return change.select("new.user_id", F.col("old.n").alias("old_n"), F.col("new.n").alias("new_n"), F.col("delta.n__v").alias("delta_n"))


def _engine(spark, d, source: str = "events", split: str = "event_id", define: Callable[[Engine], None] = lambda e: None) -> Engine:
    e = Engine(spark, clock=lambda: AS_OF)
    t = table(spark, d, source)
    e.create_stream(source, t.schema)
    define(e)
    for i, b in enumerate(batches(t, split)):
        e.insert(source, b, batch_id=f"b{i}")
    if bad := next((q.error for q in e.queries.values() if q.error), None):
        raise RuntimeError(bad)
    return e


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def combine_of_deltas(spark, d):
    """A view of a view's changes that merges their deltas has what the view has."""
    view = View("v", keys=TYPE | {"user_id": "user_id"}, aggs={"n": A.count(), "s": A.sum_("value")})
    pieces = None
    for b in batches(table(spark, d, "events"), "event_id"):
        delta = view.ingest(b, changes=True).select("delta.*")
        pieces = delta if pieces is None else pieces.unionByName(delta)
    return rounded(view.combine(["n", "s"], ["event_type"], pieces=pieces), "s")


@query("SELECT count(*) AS groups, sum(n)::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def view_on_view(spark, d):
    """Counts groups and events of a view from its changes."""

    def define(e: Engine) -> None:
        e.create_view("users", "events", keys={"user_id": "user_id"}, aggs={"n": A.count()})
        e.create_view("sums", e.output_of("users"), aggs={"groups": A.sum_("CASE WHEN old IS NULL THEN 1L ELSE 0L END"), "n": A.sum_("new.n - coalesce(old.n, 0L)")})

    return _engine(spark, d, define=define).read("sums")


@query("SELECT c_mktsegment, count(*) AS changes FROM (SELECT DISTINCT o_custkey, o_orderkey % 3 AS b FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def output_stream_join(spark, d):
    c = table(spark, d, "customer")

    def define(e: Engine) -> None:
        e.create_view("per", "orders", keys={"o_custkey": "o_custkey"}, aggs={"n": A.count()})
        e.create_view("segments", "per", prepare=lambda x: x.join(c, F.col("new.o_custkey") == c["c_custkey"]), keys={"c_mktsegment": "c_mktsegment"}, aggs={"changes": A.count()})

    return _engine(spark, d, "orders", "o_orderkey", define).read("segments")


@query("SELECT kind, count(*) AS n, round(sum(v), 4) AS s FROM (SELECT upper(event_type) AS kind, value * 2 AS v FROM events WHERE value > 10) GROUP BY kind")
def transforms(spark, d):
    """Two transforms in a row, one into a stream and one read by its output, and a view of what comes out."""

    def define(e: Engine) -> None:
        e.create_stream("big", "kind text, v float8")
        e.create_transform("pick", "events", lambda b: b.where("value > 10").selectExpr("upper(event_type) AS kind", "value"))
        e.create_transform("twice", e.output_of("pick"), lambda b: b.selectExpr("kind", "value * 2 AS v"), into="big")
        e.create_view("sums", "big", keys={"kind": "kind"}, aggs={"n": A.count(), "s": A.sum_("v")})

    return rounded(_engine(spark, d, define=define).read("sums"), "s")


@query("SELECT count(*) AS n FROM events WHERE event_id % 3 <> 1")
def stream_targets(spark, d):
    """A batch sent to another view only, and one sent twice under its id."""
    e = Engine(spark, clock=lambda: AS_OF)
    t = table(spark, d, "events").where("event_id IS NOT NULL")
    e.create_stream("events", t.schema)
    e.create_view("a", "events", aggs={"n": A.count()})
    e.create_view("b", "events", aggs={"n": A.count()})
    zero, one, two = batches(t, "event_id")
    e.insert("events", zero, batch_id="0")
    e.insert("events", one, targets=["b"], batch_id="1")
    e.insert("events", two, batch_id="2")
    e.insert("events", two, batch_id="2")
    return e.read("a")


@query("SELECT count(*) AS n FROM events WHERE event_id % 3 = 0")
def deactivated(spark, d):
    e = Engine(spark, clock=lambda: AS_OF)
    t = table(spark, d, "events").where("event_id IS NOT NULL")
    e.create_stream("events", t.schema)
    e.create_view("a", "events", aggs={"n": A.count()})
    for i, b in enumerate(batches(t, "event_id")):
        (e.activate if i == 0 else e.deactivate)("a")
        e.insert("events", b)
    return e.read("a")


# by SQL


def _by_sql(spark, d, *views: str, source: str = "events", split: str = "event_id") -> Engine:
    def define(e: Engine) -> None:
        for v in views:
            SQL.run(e, v)

    return _engine(spark, d, source, split, define)


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, event_type LIMIT 3")
def sql_quick_start(spark, d):
    e = _by_sql(spark, d, "CREATE VIEW v WITH (action=materialize) AS SELECT event_type, count(*) FROM events GROUP BY event_type")
    return SQL.run(e, "SELECT * FROM v ORDER BY count DESC, event_type LIMIT 3")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS h, count(*) FILTER (WHERE value > 50) AS high, round(avg(value) + 1, 6) AS m, count(DISTINCT event_type) AS kinds FROM events WHERE user_id % 2 = 0 GROUP BY h")
def sql_view(spark, d):
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT hour(ts) AS h, count(*) FILTER (WHERE value > 50) AS high, avg(value) + 1 AS m, exact_count_distinct(event_type) AS kinds FROM events WHERE user_id % 2 = 0 GROUP BY h")
    return rounded(SQL.run(e, "SELECT * FROM v"), "m", digits=6)


@query("SELECT c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 GROUP BY c_mktsegment")
def sql_join(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 GROUP BY c_mktsegment", source="orders", split="o_orderkey")
    return SQL.run(e, "SELECT * FROM v")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {_IN} AND value > 3 GROUP BY event_type")
def sql_sliding(spark, d):
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, count(*) AS n FROM events WHERE ts > clock_timestamp() - interval '10 days' AND value > 3 GROUP BY event_type")
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT user_id % 4 AS g, round(avg(value), 4) AS mean, count(*) + 1 AS more FROM events GROUP BY g HAVING count(*) > 2000")
def sql_combine(spark, d):
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT user_id, avg(value) AS mean, count(*) AS n FROM events GROUP BY user_id")
    return rounded(SQL.run(e, "SELECT user_id % 4 AS g, combine(mean) AS mean, combine(n) + 1 AS more FROM v GROUP BY user_id % 4 HAVING combine(n) > 2000"), "mean")


@query("SELECT event_type, u, count(*) AS n FROM (SELECT event_type, (user_id % 2)::VARCHAR AS u FROM events) GROUP BY CUBE (event_type, u)")
def sql_cube(spark, d):
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, u, count(*) AS n FROM (SELECT event_type, CAST(user_id % 2 AS string) AS u FROM events) q GROUP BY CUBE (event_type, u)")
    return SQL.run(e, "SELECT event_type, u, n FROM v")


@query("SELECT kind, count(*) AS n FROM (SELECT upper(event_type) AS kind FROM events WHERE value > 10) GROUP BY kind")
def sql_transform(spark, d):
    e = _by_sql(
        spark, d, "CREATE STREAM big (kind text)", "CREATE VIEW t WITH (action=transform, outputfunc=insert_into_stream('big')) AS SELECT upper(event_type) AS kind FROM events WHERE value > 10",
        "CREATE VIEW v AS SELECT kind, count(*) AS n FROM big GROUP BY kind",
    )
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT event_type, 1 + count(*) FILTER (WHERE value < 20) AS rk, arg_max(user_id, event_id) AS last_user FROM events GROUP BY event_type")
def sql_aggregates(spark, d):
    e = _by_sql(spark, d, "CREATE VIEW v AS SELECT event_type, rank(20.0) WITHIN GROUP (ORDER BY value) AS rk, keyed_max(event_id, user_id) AS last_user FROM events GROUP BY event_type")
    return SQL.run(e, "SELECT * FROM v")


@query("SELECT event_type, true AS users, true AS median, true AS held, false AS absent, true AS often, 5 AS n_top, min(value) AS lo FROM events GROUP BY event_type")
def sql_sketches_tolerance(spark, d):
    """Sketches made by a view and asked by SQL, within their bounds. The filter's size is of the data, its rate such that no value asked is a false one."""
    size = max(S.BLOOM_N, table(spark, d, "events").agg(F.count_distinct("user_id")).first()[0])
    shape = f"0.000001, {size}"
    e = _by_sql(spark, d, f"CREATE VIEW v AS SELECT event_type, count(*) AS n, min(value) AS lo, hll_agg(user_id) AS h, dist_agg(value) AS t, bloom_agg(user_id, {shape}) AS b, freq_agg(user_id) AS f, topk_agg(user_id, 5) AS k, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p, exact_count_distinct(user_id) AS u, max(user_id) AS hi FROM events GROUP BY event_type")
    return SQL.run(e, f"""SELECT event_type, abs(hll_cardinality(h) - u) <= 0.02 * u AS users, dist_quantile(t, 0.5) = p AND dist_cdf(t, 1000) = 1 AND dist_cdf(t, 20) BETWEEN 0.2 AND 0.8 AS median, bloom_contains(b, hi, {shape}) AS held, bloom_contains(b, hi + 1000000000, {shape}) AS absent,
    freq(f, topk_values(k)[0]) BETWEEN topk_freqs(k)[0] AND topk_freqs(k)[0] + 0.01 * n AND freq_total(f) = n AS often, size(topk_values(k)) AS n_top, dist_quantile(t, 0) AS lo FROM v""")


@query("""SELECT c_custkey, substring(c_name, 1, 8) AS sub, lower(c_mktsegment) AS lo, upper(c_mktsegment) AS up, trim('  x ') AS tr, lpad(c_custkey::VARCHAR, 8, '0') AS lp, md5(c_name) AS md, c_custkey % 7 AS mo, round(pow(c_custkey % 10, 2), 2) AS po,
abs(c_acctbal) AS ab, ceil(c_acctbal)::BIGINT AS ce, floor(c_acctbal)::BIGINT AS fl, trunc(c_acctbal)::BIGINT AS tc, round(c_acctbal, 1) AS ro, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'none' END AS ca, c_name || '!' AS co, (c_custkey << 2) >> 1 AS sh, c_mktsegment IN ('BUILDING', 'MACHINERY') AS isin, c_name LIKE '%7' AS li FROM customer""")
def scalar_functions(spark, d):
    c = table(spark, d, "customer")
    return c.selectExpr(
        "c_custkey", "substring(c_name, 1, 8) AS sub", "lower(c_mktsegment) AS lo", "upper(c_mktsegment) AS up", "trim('  x ') AS tr", "lpad(CAST(c_custkey AS string), 8, '0') AS lp", "md5(c_name) AS md", "c_custkey % 7 AS mo", "round(pow(c_custkey % 10, 2), 2) AS po",
        "abs(c_acctbal) AS ab", "CAST(ceil(c_acctbal) AS bigint) AS ce", "CAST(floor(c_acctbal) AS bigint) AS fl", "CAST(sign(c_acctbal) * floor(abs(c_acctbal)) AS bigint) AS tc", "round(c_acctbal, 1) AS ro", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'none' END AS ca",
        "c_name || '!' AS co", "shiftright(shiftleft(c_custkey, 2), 1) AS sh", "c_mktsegment IN ('BUILDING', 'MACHINERY') AS isin", "c_name LIKE '%7' AS li",
    )


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, 1::BIGINT AS n, 'k' AS name FROM events")
def json_functions(spark, d):
    e = table(spark, d, "events")
    each = F.explode(F.from_json("props", "map<string,bigint>"))
    return e.select("event_id", each.alias("name", "k"), F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def structured_streaming(spark, d):
    """The events as a streaming source, folded batch by batch into state tables."""
    import uuid

    from ..streaming import feed, work_folder

    root = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = Engine(spark, root=f"{root}/state", clock=lambda: AS_OF)
    schema = table(spark, d, "events").schema
    e.create_stream("events", schema)
    e.create_view("v", "events", keys=TYPE, aggs={"n": A.count(), "s": A.sum_("value")})
    source = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    feed(e, "events", source, f"{root}/checkpoint", availableNow=True).awaitTermination()
    if e.queries["v"].error:
        raise RuntimeError(e.queries["v"].error)
    return rounded(e.read("v"), "s")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import surface  # noqa: F401  its queries are added here too

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import surface  # noqa: F401

    return dict(_ORACLE)
