"""Time: buckets, exact conversion of epoch numbers, days, keys."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: fixed values: nanoseconds of a unit of precision
PRECISION_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}
#: fixed value: buckets of a day or less start counting at Monday 2000-01-03, in microseconds
ORIGIN_US = 946_857_600_000_000
_UNITS = {"us": 1, "microsecond": 1, "ms": 1_000, "millisecond": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000}
_MONTHS = {"mon": 1, "month": 1, "y": 12, "year": 12}


def parse_width(width: str) -> tuple[int, int]:
    """(months, microseconds) of an interval such as '1 minute', '90m' or '1 year'; one of them is zero."""
    parts = re.findall(r"(\d+)\s*([A-Za-z]+)", width)
    if not parts or re.sub(r"(\d+)\s*([A-Za-z]+)", "", width).strip():
        raise ValueError(f"no interval: {width!r}")
    months = micros = 0
    for n, unit in parts:
        unit = unit.lower()
        unit = unit if unit in _UNITS or unit in _MONTHS else unit.removesuffix("s")
        if unit in _MONTHS:
            months += int(n) * _MONTHS[unit]
        elif unit in _UNITS:
            micros += int(n) * _UNITS[unit]
        else:
            raise ValueError(f"no unit of time: {unit!r}")
    if bool(months) == bool(micros):
        raise ValueError("a width is in months or in shorter units, more than zero")
    return months, micros


def time_bucket(width: str, time: Column) -> Column:
    """The start of the bucket of a TIMESTAMP; months count from 2000-01, shorter widths from a Monday. The session's zone is UTC."""
    months, micros = parse_width(width)
    if months:
        at = (F.year(time) - 2000) * 12 + F.month(time) - 1
        return F.add_months(F.lit("2000-01-01").cast("date"), (F.floor(at / months) * months).cast("int")).cast("timestamp")
    x = F.unix_micros(time) - F.lit(ORIGIN_US)
    return F.timestamp_micros(F.lit(ORIGIN_US) + x - F.pmod(x, F.lit(micros)))


def register_time_bucket(spark: SparkSession) -> None:
    """``time_bucket('1 minute', time)`` in SQL; an expression that the optimizer inlines."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION time_bucket(w STRING, t TIMESTAMP) RETURNS TIMESTAMP RETURN
        CASE WHEN months_between(timestamp_micros(0) + cast(w AS INTERVAL), timestamp_micros(0)) >= 1 AND lower(w) RLIKE 'mon|year'
        THEN cast(add_months(DATE'2000-01-01',
             cast(round(months_between(timestamp_micros(0) + cast(w AS INTERVAL), timestamp_micros(0))) AS INT)
             * cast(floor(((year(t) - 2000) * 12 + month(t) - 1) / round(months_between(timestamp_micros(0) + cast(w AS INTERVAL), timestamp_micros(0)))) AS INT)) AS TIMESTAMP)
        ELSE timestamp_micros({ORIGIN_US} + (unix_micros(t) - {ORIGIN_US})
             - pmod(unix_micros(t) - {ORIGIN_US}, unix_micros(timestamp_micros(0) + cast(w AS INTERVAL)))) END""")


def timestamp_of_ns(ns: Column) -> Column:
    """A TIMESTAMP of epoch nanoseconds, rounded as a float of seconds rounds to microseconds."""
    seconds = (ns.cast("decimal(19,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("double")
    whole = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("bigint")
    return F.timestamp_micros(whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("bigint"))


def utc_day(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def padded(seq: Column | int) -> Column | str:
    """A sequence number in twenty digits, so that names sort as numbers."""
    return f"{seq:020d}" if isinstance(seq, int) else F.lpad(seq.cast("string"), 20, "0")


def as_utc(time: datetime | str | None) -> datetime | None:
    """An aware UTC datetime; a naive one is taken as UTC."""
    if time is None:
        return None
    if isinstance(time, str):
        time = datetime.fromisoformat(time)
    return time.replace(tzinfo=UTC) if time.tzinfo is None else time.astimezone(UTC)
