"""Mergeable series counts: one HyperLogLog sketch per metric and hour, united over any window."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.times import bucket_start, time_bucket, ts_lit, utc

HOUR = 3_600
LG_K = 12  # 4096 registers, at most about 4 KB a sketch


def hourly_sketches(samples: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``hour, metric_id, sketch``; combined on the map side, so a hot metric is no hot task."""
    hour = time_bucket("time", HOUR).alias("hour")
    return samples.groupBy(hour, "metric_id").agg(F.hll_sketch_agg("labels_key", lg_k).alias("sketch"))


def fold(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored sketches with those of new samples; the same samples again change nothing."""
    both = stored.unionByName(fresh)
    return both.groupBy("hour", "metric_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def recent_series(sketches: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Estimated series per metric in the hours that the window before ``as_of`` touches.

    At most ``hours`` + 1 sketches per metric are read, and no samples. The first hour counts whole,
    so the window may be up to an hour longer than that of the exact count.
    """
    last = utc(as_of)
    first = bucket_start(last - timedelta(hours=hours), HOUR)
    found = sketches.filter(F.col("hour").between(ts_lit(first), ts_lit(last)))
    return found.groupBy("metric_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("series"))


def sliding_series(sketches: DataFrame, hours: int = 24) -> DataFrame:
    """The estimate per metric for every window of whole hours that holds a sample.

    ``window_end`` is exclusive. A sketch is sent to each of its ``hours`` windows, united on the
    map side first; nothing is kept per label set.
    """
    micros = F.unix_micros("hour")
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(hours)), lambda k: F.timestamp_micros(micros + k * F.lit(HOUR * 1_000_000))
    )
    sent = sketches.select("metric_id", F.explode(ends).alias("window_end"), "sketch")
    return sent.groupBy("metric_id", "window_end").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("series")
    )


def within_bound(estimate: Column, exact: Column, lg_k: int = LG_K, deviations: float = 4.0) -> Column:
    """Whether an estimate keeps its error bound: so many standard errors, one series at least."""
    bound = F.greatest(F.lit(1.0), exact * (deviations * 1.04 / 2 ** (lg_k / 2)))
    return F.abs(estimate - exact) <= bound


def utilisation(estimates: DataFrame, most: int, warning_threshold: float) -> DataFrame:
    """The limit's state per metric, from estimates."""
    return estimates.select(
        "metric_id", F.col("series").alias("current_cardinality"), F.lit(most).alias("max_allowed"),
        (F.col("series") * 100.0 / most).alias("utilization_percent"),
        (F.col("series") > most * warning_threshold).alias("is_warning"),
        (F.col("series") >= most).alias("is_critical"),
    )
