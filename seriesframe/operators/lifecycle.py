"""Retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.times import ts_lit


def _expired(as_of, default_days: int) -> Column:
    days = F.coalesce("retention_days", F.lit(default_days))
    return F.col("time") < ts_lit(as_of) - F.make_dt_interval(days)


def _with_retention(samples: DataFrame, metrics: DataFrame) -> DataFrame:
    limits = metrics.select(F.col("id").alias("metric_id"), "retention_days")
    return samples.join(limits, "metric_id", "left")


def retained(samples: DataFrame, metrics: DataFrame, as_of, default_days: int = 30) -> DataFrame:
    """Samples not older than the retention of their metric."""
    marked = _with_retention(samples, metrics)
    return marked.filter(~_expired(as_of, default_days)).select(*samples.columns)


def expired(samples: DataFrame, metrics: DataFrame, as_of, default_days: int = 30) -> DataFrame:
    marked = _with_retention(samples, metrics)
    return marked.filter(_expired(as_of, default_days)).select(*samples.columns)
