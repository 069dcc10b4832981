"""Rollups: per-series bucket aggregates, and their re-aggregation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.labels import from_key
from seriesframe.functions.times import bucket_start, time_bucket, utc
from seriesframe.operators.aggregates import newest_buckets
from seriesframe.operators.filters import filter_labels, filter_time
from seriesframe.schema import SERIES


@dataclass(frozen=True)
class Grain:
    """A rollup width and its refresh band [now - start, now - end]."""

    name: str
    seconds: int
    refresh_start: timedelta
    refresh_end: timedelta


# The three grains and their refresh offsets.
GRAINS = {
    "5m": Grain("5m", 300, timedelta(minutes=15), timedelta(minutes=5)),
    "1h": Grain("1h", 3_600, timedelta(hours=3), timedelta(hours=1)),
    "1d": Grain("1d", 86_400, timedelta(days=7), timedelta(days=1)),
}


def _with_average() -> list[Column]:
    return [
        (F.col("sum_value") / F.col("sample_count")).alias("avg_value"),
        "sum_value", "min_value", "max_value", "sample_count",
    ]


def rollup(samples: DataFrame, grain: str) -> DataFrame:
    """Aggregates per bucket and series, straight from samples."""
    bucket = time_bucket("time", GRAINS[grain].seconds).alias("bucket")
    return (
        samples.groupBy(bucket, *SERIES)
        .agg(
            F.sum("value").alias("sum_value"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.count("value").alias("sample_count"),
        )
        .select("bucket", *SERIES, *_with_average())
    )


def coarsen(finer: DataFrame, grain: str) -> DataFrame:
    """A coarser rollup from a finer one: sums, counts and extremes merge exactly."""
    bucket = time_bucket("bucket", GRAINS[grain].seconds).alias("bucket")
    return finer.groupBy(bucket, *SERIES).agg(*_merge()).select("bucket", *SERIES, *_with_average())


def _merge() -> list[Column]:
    return [
        F.sum("sum_value").alias("sum_value"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.sum("sample_count").alias("sample_count"),
    ]


def rollup_rows(table: DataFrame, metric_id: str, start, end, labels=None) -> DataFrame:
    """Rollup rows of one metric with ``start <= bucket <= end``."""
    found = filter_time(table.filter(F.col("metric_id") == metric_id), start, end, "bucket")
    if labels:
        found = filter_labels(found.withColumn("labels", from_key("labels_key")), labels)
    return found


def read_rollup(table: DataFrame, metric_id: str, start, end, labels=None) -> DataFrame:
    """The same, newest first."""
    return rollup_rows(table, metric_id, start, end, labels).orderBy(
        F.col("bucket").desc(), "labels_key"
    )


def merge_over_labels(rows: DataFrame, width_seconds: int) -> DataFrame:
    """Re-aggregate rollup rows over label sets into buckets of ``width_seconds``."""
    bucket = time_bucket("bucket", width_seconds).alias("bucket")
    return rows.groupBy(bucket).agg(*_merge()).select("bucket", *_with_average())


def pick_grain(width_seconds: int) -> str | None:
    """The coarsest rollup whose buckets tile buckets of this width."""
    fitting = [g for g in GRAINS.values() if width_seconds % g.seconds == 0]
    return max(fitting, key=lambda g: g.seconds).name if fitting else None


def routed_buckets(
    samples: DataFrame,
    rollup_table: DataFrame,
    grain: str,
    width_seconds: int,
    start,
    end,
    fresh_until: datetime | None = None,
    valid_days: Iterable[date] | None = None,
) -> DataFrame:
    """Bucket statistics from a rollup, equal to those from the samples.

    Whole rollup buckets inside the range come from the table. The cut buckets at both edges,
    everything from ``fresh_until`` on, and days that are not in ``valid_days`` (None: all are),
    come from the samples, so only a sliver is scanned. ``samples`` and ``rollup_table`` hold one
    metric, already filtered by labels.
    """
    seconds = GRAINS[grain].seconds
    step = timedelta(seconds=seconds)
    first, last = utc(start), utc(end)
    begin = bucket_start(first, seconds)
    begin = begin if begin == first else begin + step
    until = bucket_start(last, seconds)
    if fresh_until is not None:
        until = min(until, bucket_start(fresh_until, seconds))
    until = max(until, begin)

    whole = filter_time(rollup_table, begin, until, "bucket").filter(F.col("bucket") < until)
    inside = (F.col("time") >= F.lit(begin)) & (F.col("time") < F.lit(until))
    near_edge = (F.col("day") <= F.lit(begin.date())) | (F.col("day") >= F.lit(until.date()))
    if valid_days is not None:
        days = [F.lit(day) for day in sorted(set(valid_days))]
        whole = whole.filter(F.to_date("bucket").isin(days))
        inside = inside & F.to_date("time").isin(days)
        near_edge = near_edge | ~F.col("day").isin(days)
    edges = filter_time(samples, first, last).filter(~inside)
    if "day" in samples.columns:
        edges = edges.filter(near_edge)
    columns = ["bucket", "sum_value", "min_value", "max_value", "sample_count"]
    partial = edges.groupBy(time_bucket("time", seconds).alias("bucket")).agg(
        F.sum("value").alias("sum_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count("value").alias("sample_count"),
    )
    return merge_over_labels(whole.select(*columns).unionByName(partial), width_seconds)


def routed_agg(buckets: DataFrame, aggregation: str, limit: int | None = None) -> DataFrame:
    """One aggregate of routed buckets as (bucket, value), newest first."""
    column = {
        "SUM": "sum_value", "MIN": "min_value", "MAX": "max_value", "COUNT": "sample_count",
    }.get(aggregation.upper(), "avg_value")
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("value")
    return newest_buckets(buckets.select("bucket", value), limit)


def refresh_band(grain: str, as_of) -> tuple[datetime, datetime]:
    """[first bucket, end) of the whole buckets inside the refresh band of ``as_of``."""
    spec = GRAINS[grain]
    step = timedelta(seconds=spec.seconds)
    low = utc(as_of) - spec.refresh_start
    begin = bucket_start(low, spec.seconds)
    begin = begin if begin == low else begin + step
    return begin, max(begin, bucket_start(utc(as_of) - spec.refresh_end, spec.seconds))
