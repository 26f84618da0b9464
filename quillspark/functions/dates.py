"""Dates: fixed UTC+8 epochs, hour alignment, violation windows, date partitions, durations."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET = "+08:00"


def epoch_at_offset(day: Column) -> Column:
    """``yyyy-MM-dd`` to the epoch seconds of its midnight at UTC+8."""
    return F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(day, "yyyy-MM-dd"), OFFSET))


def local_time(epoch: Column) -> Column:
    """Epoch seconds to the wall clock at UTC+8 (a fixed offset, without historic summer time)."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), OFFSET).cast("timestamp_ntz")


def local_parts(epoch: Column) -> Column:
    t = local_time(epoch)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"))


def date_keys(epoch: Column) -> Column:
    """Keys at three grains: yyyymmdd, yyyymm, yyyy."""
    t = local_time(epoch)
    return F.array(*[F.date_format(t, p) for p in ("yyyyMMdd", "yyyyMM", "yyyy")])


def hour_floor(ts: Column, offset: dt.timedelta | None = None) -> Column:
    hour = F.date_trunc("HOUR", ts).cast("timestamp_ntz")
    return hour + F.lit(offset) if offset else hour


def violation_window(latest: Column, sla: Column, size: Column) -> tuple[Column, Column]:
    """(start, end): the end is the hour of ``latest - sla``, the start ``size`` before it."""
    end = F.date_trunc("HOUR", latest - sla).cast("timestamp_ntz")
    return end - size, end


def in_window(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def dates_between(df: DataFrame, first: Column, last: Column, name: str = "date") -> DataFrame:
    """One row for each date from the least ``first`` to the greatest ``last``, for partition pruning."""
    bounds = df.agg(F.min(F.to_date(first)).alias("_a"), F.max(F.to_date(last)).alias("_b")).where("_a is not null")
    return bounds.select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(name))


def parse_duration(text: str) -> dt.timedelta:
    """``5 min``, ``2h``, ``1d``, ``30s``, ``500ms``; a bare number counts milliseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Zµ]*)\s*", text)
    units = {"d": ("d", "day", "days"), "h": ("h", "hour", "hours"), "min": ("m", "min", "minute", "minutes"), "s": ("s", "sec", "secs", "second", "seconds"), "ms": ("", "ms", "milli", "millis", "millisecond", "milliseconds"), "us": ("us", "µs", "micro", "micros", "microsecond", "microseconds")}
    unit = next((k for k, names in units.items() if m and m[2].lower() in names), None)
    if unit is None:
        raise ValueError(f"not a duration: {text!r}")
    return dt.timedelta(**{{"d": "days", "h": "hours", "min": "minutes", "s": "seconds", "ms": "milliseconds", "us": "microseconds"}[unit]: int(m[1])})
