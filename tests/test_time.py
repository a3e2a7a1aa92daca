"""Rounding and truncation of times."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tributary.functions.time import date_round, hash_group, interval_micros, ls_hash_group, truncated

T = dt.datetime(2001, 2, 16, 20, 38, 40)


@pytest.mark.parametrize(
    ("text", "micros"),
    [("1 hour", 3_600_000_000), ("1 hour 30 minutes", 5_400_000_000), ("00:05:00", 300_000_000), ("2 months", 60 * 86_400_000_000), ("1 year", 366 * 86_400_000_000), ("90 s", 90_000_000), ("1.5 days", 129_600_000_000), ("250 ms", 250_000), ("interval '2 weeks'", 14 * 86_400_000_000)],
)
def test_interval(text, micros):
    assert interval_micros(text) == micros


@pytest.mark.parametrize("bad", ["", "soon", "3 parsecs", "5"])
def test_interval_refused(bad):
    with pytest.raises(ValueError):
        interval_micros(bad)


@pytest.mark.parametrize(
    ("moment", "interval", "want"),
    [
        (T, "1 hour", dt.datetime(2001, 2, 16, 20)), (T, "10 minutes", dt.datetime(2001, 2, 16, 20, 30)), (T, "1 day", dt.datetime(2001, 2, 16)),
        (T, "7 days", dt.datetime(2001, 2, 10)), (T, "2 months", dt.datetime(2000, 12, 26)), (dt.datetime(1999, 12, 31, 23, 59, 50), "1 minute", dt.datetime(2000, 1, 1)),
    ],
)
def test_date_round(spark, moment, interval, want):
    """Before 2000 the remainder is negative, so those times are rounded up."""
    row = spark.createDataFrame([(moment,)], "t timestamp_ntz").select(date_round("t", interval).alias("r"), date_round(F.col("t").cast("timestamp"), interval).cast("timestamp_ntz").alias("z")).first()
    assert row["r"] == want and row["z"] == want


def test_date_round_of_null_and_refusals(spark):
    assert spark.createDataFrame([(None,)], "t timestamp_ntz").select(date_round("t", "1 hour").alias("r")).first()["r"] is None
    with pytest.raises(ValueError):
        date_round("t", "0 s")
    with pytest.raises(ValueError):
        truncated("decade", "t")


def test_truncated(spark):
    got = spark.createDataFrame([(T,)], "t timestamp").select(*[truncated(u, "t").cast("timestamp_ntz").alias(u) for u in ("year", "month", "day", "hour", "minute", "second")]).first()
    assert list(got) == [dt.datetime(2001, 1, 1), dt.datetime(2001, 2, 1), dt.datetime(2001, 2, 16), dt.datetime(2001, 2, 16, 20), dt.datetime(2001, 2, 16, 20, 38), T]


def test_hashes(spark):
    df = spark.createDataFrame([(T, 1), (T + dt.timedelta(seconds=1), 1), (T, None)], "t timestamp_ntz, x int")
    rows = df.select(ls_hash_group("t", "x").alias("l"), hash_group("x").alias("h")).collect()
    assert rows[1]["l"] - rows[0]["l"] == 1 << 32 and rows[0]["h"] == rows[1]["h"] and rows[2]["h"] is not None
