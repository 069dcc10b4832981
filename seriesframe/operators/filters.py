"""Row filters on samples, and the checks on a requested time range."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.labels import contains
from seriesframe.functions.times import day_of, ts_lit, utc


def filter_time(samples: DataFrame, start, end, column: str = "time") -> DataFrame:
    """``start <= time <= end``; also prunes day partitions when the table has them."""
    found = samples.filter(F.col(column).between(ts_lit(start), ts_lit(end)))
    if "day" in samples.columns:
        found = found.filter(F.col("day").between(F.lit(day_of(start)), F.lit(day_of(end))))
    return found


def filter_time_half_open(samples: DataFrame, start, end) -> DataFrame:
    """``start <= time < end``, for day chunks."""
    found = samples.filter((F.col("time") >= ts_lit(start)) & (F.col("time") < ts_lit(end)))
    if "day" in samples.columns:
        last = day_of(utc(end) - timedelta(microseconds=1))
        found = found.filter(F.col("day").between(F.lit(day_of(start)), F.lit(last)))
    return found


def filter_age(samples: DataFrame, cutoff) -> DataFrame:
    """Samples strictly older than the cutoff."""
    found = samples.filter(F.col("time") < ts_lit(cutoff))
    if "day" in samples.columns:
        found = found.filter(F.col("day") <= F.lit(day_of(cutoff)))
    return found


def filter_labels(samples: DataFrame, wanted: Mapping[str, str] | None) -> DataFrame:
    """Label containment; None or an empty mapping filters nothing."""
    return samples.filter(contains("labels", wanted)) if wanted else samples


def filter_metric(samples: DataFrame, metric_id: str) -> DataFrame:
    return samples.filter(F.col("metric_id") == F.lit(metric_id))


def default_range(
    start, end, as_of, hours: int = 24
) -> tuple[datetime, datetime]:
    """Missing end = as_of, missing start = end - 24 h. The clock never enters a plan."""
    last = utc(end) if end is not None else utc(as_of)
    first = utc(start) if start is not None else last - timedelta(hours=hours)
    return first, last


def check_range(start: datetime, end: datetime, max_days: int) -> None:
    if start > end:
        raise ValueError("the start of the range lies after its end")
    if end - start > timedelta(days=max_days):
        raise ValueError(f"the range is longer than {max_days} days")
