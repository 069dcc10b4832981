"""Range, bucket and statistics aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.times import time_bucket, ts_lit
from seriesframe.operators.percentiles import exact_percentiles

PLAIN_AGGREGATES = ("SUM", "AVG", "MIN", "MAX", "COUNT")


def aggregate_value(aggregation: str, value: Column | str = "value") -> Column:
    """One aggregate as a double; NULL becomes 0.0 and an unknown name means the average."""
    makers = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
    made = makers.get(aggregation.upper(), F.avg)(value)
    return F.coalesce(made.cast("double"), F.lit(0.0))


def five_aggregates(value: Column | str = "value") -> list[Column]:
    return [
        F.avg(value).alias("avg_value"),
        F.sum(value).alias("sum_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count(value).alias("sample_count"),
    ]


def newest_buckets(buckets: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limit plans as a top-k, never as a full sort."""
    ordered = buckets.orderBy(F.col("bucket").desc())
    return ordered if limit is None else ordered.limit(limit)


def bucket_stats(samples: DataFrame, width_seconds: int) -> DataFrame:
    """avg, sum, min, max, count per time bucket; empty buckets are absent."""
    bucket = time_bucket("time", width_seconds).alias("bucket")
    return samples.groupBy(bucket).agg(*five_aggregates())


def bucket_agg(
    samples: DataFrame, width_seconds: int, aggregation: str, limit: int | None = None
) -> DataFrame:
    """One aggregate per bucket as (bucket, value), newest first."""
    bucket = time_bucket("time", width_seconds).alias("bucket")
    made = samples.groupBy(bucket).agg(aggregate_value(aggregation).alias("value"))
    return newest_buckets(made, limit)


def overall_agg(samples: DataFrame, start, aggregation: str) -> DataFrame:
    """One (timestamp, value) row for the whole range; no row when the range is empty."""
    return (
        samples.agg(aggregate_value(aggregation).alias("value"), F.count("value").alias("n"))
        .filter("n > 0")
        .select(ts_lit(start).alias("timestamp"), "value")
    )


def percentile(
    samples: DataFrame, end, fraction: float, max_group_rows: int
) -> DataFrame:
    """Interpolated percentile of the whole range, as one row at its end; 0.0 when empty."""
    found = exact_percentiles(samples, [], "value", [fraction], max_group_rows)
    return found.select(
        ts_lit(end).alias("timestamp"),
        F.coalesce(F.col("percentiles")[0], F.lit(0.0)).alias("value"),
    )


def percentile_bucketed(
    samples: DataFrame, width_seconds: int, fraction: float, max_group_rows: int
) -> DataFrame:
    """The percentile per bucket, newest first."""
    bucketed = samples.select(time_bucket("time", width_seconds).alias("bucket"), "value")
    found = exact_percentiles(bucketed, ["bucket"], "value", [fraction], max_group_rows)
    return newest_buckets(
        found.select("bucket", F.col("percentiles")[0].alias("value")), limit=None
    )


def statistics(samples: DataFrame, max_group_rows: int) -> DataFrame:
    """avg, sum, min, max, count, p50, p95, p99 of the range in one row.

    An empty range gives 0.0 for the percentiles and NULL for the rest.
    """
    found = exact_percentiles(
        samples, [], "value", [0.5, 0.95, 0.99], max_group_rows,
        extra=[
            F.avg("value").alias("avg"), F.sum("value").alias("sum"),
            F.min("value").alias("min"), F.max("value").alias("max"),
            F.nullif(F.count("value"), F.lit(0)).alias("count"),
        ],
    )
    rank = {0: "p50", 1: "p95", 2: "p99"}
    return found.select(
        "avg", "sum", "min", "max", "count",
        *[F.coalesce(F.col("percentiles")[i], F.lit(0.0)).alias(n) for i, n in rank.items()],
    )
