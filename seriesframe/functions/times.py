"""Time helpers: UTC literals, intervals, buckets, tiers."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket origin Monday 2000-01-03 00:00 UTC, as days after the epoch.
ORIGIN_DAYS = 10_959
DAY_SECONDS = 86_400
ISO_INSTANT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?"
    r"([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)\z"
)
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3_600, "d": DAY_SECONDS}


def utc(value: datetime | str) -> datetime:
    """Datetime or ISO-8601 text as an aware UTC datetime; naive values are taken as UTC."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError:
            raise ValueError(f"not an ISO-8601 timestamp: {value!r}") from None
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def ts_lit(value: datetime | str) -> Column:
    return F.lit(utc(value))


def day_of(value: datetime | str) -> date:
    return utc(value).date()


def parse_interval(text: str | None) -> int | None:
    """``5m`` -> 300. Blank means no interval; a zero width is refused."""
    if text is None or not text.strip():
        return None
    found = re.fullmatch(r"([0-9]+)([smhd])", text)
    if not found:
        raise ValueError(f"invalid interval {text!r}: use a number and one of s, m, h, d")
    seconds = int(found[1]) * UNIT_SECONDS[found[2]]
    if seconds == 0:
        raise ValueError(f"invalid interval {text!r}: the width must not be zero")
    return seconds


def bucket_offset(width_seconds: int) -> int:
    """Seconds by which buckets of this width are shifted against the epoch."""
    return (ORIGIN_DAYS * DAY_SECONDS) % width_seconds


def time_bucket(time: Column | str, width_seconds: int) -> Column:
    """Start of the bucket holding ``time``: plain integer arithmetic, one column, codegen."""
    micros = F.unix_micros(time)
    width = F.lit(width_seconds * 1_000_000)
    shift = F.lit(bucket_offset(width_seconds) * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros - shift, width))


def bucket_start(value: datetime | str, width_seconds: int) -> datetime:
    """Driver-side twin of :func:`time_bucket`, for range edges."""
    origin = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(days=ORIGIN_DAYS)
    width = timedelta(seconds=width_seconds)
    return origin + (utc(value) - origin) // width * width


def stream_window(time: Column | str, width_seconds: int) -> Column:
    """The same buckets as a window column, which streaming aggregation needs."""
    width = f"{width_seconds} seconds"
    return F.window(time, width, width, f"{bucket_offset(width_seconds)} seconds")


def seconds_between(start: Column, end: Column) -> Column:
    """Fractional seconds, microsecond exact."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def utc_day(time: Column | str) -> Column:
    return F.to_date(time)


def parse_iso(text: Column | str) -> Column:
    """Timestamp of an ISO-8601 instant (date, T, time with seconds, zone); NULL otherwise."""
    trimmed = F.trim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed.rlike(ISO_INSTANT), F.try_to_timestamp(trimmed))


def tier(time: Column | str, as_of: datetime | str, hot_days: int = 10, warm_days: int = 30) -> Column:
    """hot / warm / cold by age at ``as_of``; a bound belongs to the older tier."""
    now = utc(as_of)
    col = F.col(time) if isinstance(time, str) else time
    return (
        F.when(col > F.lit(now - timedelta(days=hot_days)), F.lit("hot"))
        .when(col > F.lit(now - timedelta(days=warm_days)), F.lit("warm"))
        .otherwise(F.lit("cold"))
    )
