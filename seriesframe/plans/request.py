"""Query requests and the DataFrame each one stands for.

A plan stays lazy: resolve the metric, prune to its range, filter labels, then one operator.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.config import Settings
from seriesframe.functions.labels import from_key, literal_map
from seriesframe.functions.times import parse_interval, utc
from seriesframe.operators import aggregates, counters
from seriesframe.operators.filters import check_range, default_range, filter_labels, filter_time


class Aggregation(str, Enum):
    SUM = "SUM"
    AVG = "AVG"
    MIN = "MIN"
    MAX = "MAX"
    COUNT = "COUNT"
    P50 = "P50"
    P75 = "P75"
    P90 = "P90"
    P95 = "P95"
    P99 = "P99"
    RATE = "RATE"

    @property
    def fraction(self) -> float | None:
        return int(self.value[1:]) / 100 if self.value[0] == "P" else None


@dataclass(frozen=True)
class QueryRequest:
    metric: str
    start: object = None
    end: object = None
    labels: Mapping[str, str] = field(default_factory=dict)
    aggregation: Aggregation | None = None
    interval: str | None = None
    limit: int | None = None  # newest points; None gives all


def raw_points(samples: DataFrame, limit: int | None) -> DataFrame:
    """Newest first; plans as a top-k per partition and one merge."""
    return counters.newest_points(samples, limit)


def instant(samples: DataFrame, at, window_seconds: int = 60) -> DataFrame:
    """The newest sample in [at - window, at]; no row when there is none."""
    return raw_points(_last_seconds(samples, at, window_seconds), 1)


def instant_per_series(samples: DataFrame, at, window_seconds: int = 60) -> DataFrame:
    """The newest sample of every series in [at - window, at], as one aggregate."""
    return _last_seconds(samples, at, window_seconds).groupBy("metric_id", "labels_key").agg(
        F.max("time").alias("time"), F.max_by("value", "time").alias("value")
    )


def _last_seconds(samples: DataFrame, at, seconds: int) -> DataFrame:
    return filter_time(samples, utc(at) - timedelta(seconds=seconds), at)


def check_request(request: QueryRequest, settings: Settings, as_of):
    """(start, end, bucket width) of a valid request; raises otherwise."""
    if not request.metric.strip():
        raise ValueError("the metric name is blank")
    if request.limit is not None and not 1 <= request.limit <= settings.query.max_limit:
        raise ValueError(f"the limit must lie in 1..{settings.query.max_limit}")
    start, end = default_range(
        request.start, request.end, as_of, settings.query.default_range_hours
    )
    check_range(start, end, settings.query.max_range_days)
    return start, end, parse_interval(request.interval)


def plan(
    request: QueryRequest, samples: DataFrame, metric_type: str, as_of,
    settings: Settings = Settings(),
) -> DataFrame:
    """``timestamp, value, labels`` for samples of one metric.

    Labels filter every aggregation. For aggregates the result carries the requested labels.
    """
    start, end, width = check_request(request, settings, as_of)
    found = filter_labels(filter_time(samples, start, end), request.labels)
    aggregation = request.aggregation
    if aggregation is None:
        return raw_points(found, request.limit).select(
            F.col("time").alias("timestamp"), "value", "labels"
        )
    if aggregation is Aggregation.RATE:
        if metric_type != "COUNTER":
            raise ValueError("a rate needs a counter metric")
        # The label map follows from its key, so it need not travel through the window.
        rates = counters.rate(found.drop("labels"), settings.skew.series_rows)
        return counters.newest_points(rates, request.limit).select(
            F.col("time").alias("timestamp"), F.col("rate").alias("value"),
            from_key("labels_key").alias("labels"),
        )
    if aggregation.fraction is not None:
        most = settings.skew.percentile_rows
        if width is None:
            made = aggregates.percentile(found, end, aggregation.fraction, most)
        else:
            made = aggregates.percentile_bucketed(found, width, aggregation.fraction, most)
            if settings.query.max_buckets is not None:
                made = made.limit(settings.query.max_buckets)
            made = made.withColumnRenamed("bucket", "timestamp")
    elif width is None:
        made = aggregates.overall_agg(found, start, aggregation.value)
    else:
        made = aggregates.bucket_agg(
            found, width, aggregation.value, settings.query.max_buckets
        ).withColumnRenamed("bucket", "timestamp")
    return made.withColumn("labels", literal_map(request.labels))


def range_query(samples: DataFrame, start, end, step: str, labels=None, limit: int | None = None) -> DataFrame:
    """Average per step as (bucket, value), newest first."""
    width = parse_interval(step)
    if width is None:
        raise ValueError("a range query needs a step")
    return aggregates.bucket_agg(
        filter_labels(filter_time(samples, start, end), labels), width, "AVG", limit
    )

