"""Time functions: rounding to multiples of an interval, and truncation to a unit."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounding counts from this moment.
ORIGIN = dt.datetime(2000, 1, 1)
_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}
_SHORT = {"us": "microsecond", "ms": "millisecond", "s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mon": "month", "y": "year", "yr": "year"}


def interval_micros(text: str | dt.timedelta | int) -> int:
    """Microseconds of an interval: '1 hour 30 minutes', '00:05:00', a timedelta, or a number of seconds.

    Months and years have the length they have when added to 2000-01-01, so two months are 60 days.
    """
    if isinstance(text, dt.timedelta):
        return round(text.total_seconds() * 1_000_000)
    if isinstance(text, (int, float)):
        return round(text * 1_000_000)
    total, rest = 0, text.strip().lower()
    months = 0
    if m := re.search(r"([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?", rest):
        micros = int(m[2]) * _UNITS["hour"] + int(m[3]) * _UNITS["minute"] + round(float(m[4] or 0) * 1_000_000)
        total += -micros if m[1] == "-" else micros
        rest = rest[: m.start()] + rest[m.end() :]
    for number, unit in re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", rest):
        name = _SHORT.get(unit, unit.rstrip("s") if unit not in _SHORT else unit)
        name = _SHORT.get(name, name)
        if name in ("month", "year"):
            months += round(float(number) * (12 if name == "year" else 1))
        elif name in _UNITS:
            total += round(float(number) * _UNITS[name])
        else:
            raise ValueError(f"unknown interval unit {unit!r} in {text!r}")
    left = re.sub(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", "", rest).replace("interval", "").strip(" '\"")
    if left or not (total or months or re.search(r"\d", text)):
        raise ValueError(f"not an interval: {text!r}")
    if months:
        year, month = divmod(ORIGIN.month - 1 + months, 12)
        total += round((ORIGIN.replace(year=ORIGIN.year + year, month=month + 1) - ORIGIN).total_seconds() * 1_000_000)
    return total


def date_round(ts: Column | str, interval: str | dt.timedelta | int) -> Column:
    """ts less its remainder by interval since 2000-01-01; the type of ts is kept. Before 2000 this rounds up."""
    ts = F.expr(ts) if isinstance(ts, str) else ts
    micros = interval_micros(interval)
    if micros <= 0:
        raise ValueError("the interval must be positive")
    since = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.timestamp_add("MICROSECOND", -(since % F.lit(micros)), ts)


def truncated(unit: str, ts: Column | str) -> Column:
    """ts cut to the start of its year, month, day, hour, minute or second, still a timestamp."""
    if unit not in ("year", "month", "day", "hour", "minute", "second"):
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_trunc(unit, F.expr(ts) if isinstance(ts, str) else ts)


def to_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("SECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def hash_group(*columns: Column | str) -> Column:
    """A 32-bit hash of a group's columns; nulls take part."""
    return F.hash(*[F.expr(c) if isinstance(c, str) else c for c in columns])


def ls_hash_group(ts: Column | str, *columns: Column | str) -> Column:
    """A 64-bit hash whose high half is the time in seconds, so that groups near in time sort near each other."""
    ts = F.expr(ts) if isinstance(ts, str) else ts
    low = hash_group(*columns).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) if columns else F.lit(0).cast("long")
    return F.shiftleft(F.coalesce(to_seconds(ts), F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(low)
