"""Series cardinality: counts, utilisation, label cardinality and the series limit."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesframe.config import CardinalityLimits
from seriesframe.functions.times import day_of, time_bucket, ts_lit, utc
from seriesframe.schema import SERIES
from seriesframe.session import materialize


def recent(samples: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Samples strictly newer than ``as_of`` minus the check window."""
    since = utc(as_of) - timedelta(hours=hours)
    found = samples.filter(F.col("time") > ts_lit(since))
    if "day" in samples.columns:
        found = found.filter(F.col("day") >= F.lit(day_of(since)))
    return found


def cardinality(samples: DataFrame, as_of, hours: int = 24, approximate: bool = False) -> DataFrame:
    """Distinct label sets per metric in the check window.

    Exact by default: distinct (metric, label set) pairs first, then a count, so a metric that
    holds most rows is still spread over its label sets. ``approximate`` uses a sketch instead.
    """
    counter = F.approx_count_distinct if approximate else F.countDistinct
    return recent(samples, as_of, hours).groupBy("metric_id").agg(
        counter("labels_key").alias("series")
    )


def sliding_cardinality(samples: DataFrame, hours: int = 24) -> DataFrame:
    """Exact series per metric for every window of whole hours that holds a sample.

    Rows collapse to one per series and hour, then to one per series and window, before the count.
    """
    hour = F.unix_micros(time_bucket("time", 3_600))
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(hours)), lambda k: F.timestamp_micros(F.col("hour") + k * F.lit(3_600_000_000))
    )
    seen = samples.select(*SERIES, hour.alias("hour")).distinct()
    sent = seen.select(*SERIES, F.explode(ends).alias("window_end")).distinct()
    return sent.groupBy("metric_id", "window_end").agg(F.count("*").alias("exact_series"))


def cardinality_stats(
    samples: DataFrame, as_of, limits: CardinalityLimits = CardinalityLimits()
) -> DataFrame:
    most = limits.max_series_per_metric
    return cardinality(samples, as_of, limits.check_window_hours).select(
        "metric_id",
        F.col("series").alias("current_cardinality"),
        F.lit(most).alias("max_allowed"),
        (F.col("series") * 100.0 / most).alias("utilization_percent"),
        (F.col("series") > most * limits.warning_threshold).alias("is_warning"),
        (F.col("series") >= most).alias("is_critical"),
    )


def label_cardinality(samples: DataFrame) -> DataFrame:
    """Distinct values per metric and label key.

    Samples collapse to their series before the labels are unfolded.
    """
    series = samples.select(*SERIES).distinct()
    pairs = series.select(
        "metric_id", F.explode(F.from_json("labels_key", "map<string,string>"))
    )
    return pairs.groupBy("metric_id", F.col("key").alias("label_key")).agg(
        F.countDistinct("value").alias("distinct_values")
    )


def mark_series_limit(
    incoming: DataFrame, samples: DataFrame, as_of, limits: CardinalityLimits = CardinalityLimits(),
    order: str = "idx", eligible: Column | None = None,
) -> DataFrame:
    """Adds ``series`` (current count of the metric) and ``over_limit`` to incoming samples.

    With ``at_limit="unseen"`` only samples of new series are over the limit of a full metric;
    with ``"strict_all"`` every sample of it is. With ``"quota"`` the limit holds within the batch:
    of a metric's new series the first by ``order`` are admitted until it is full, all others are
    over the limit, and ``series`` counts the admitted ones. Rows that are not ``eligible``,
    being rejected anyway, take no place.
    """
    if limits.at_limit == "quota":
        return _mark_quota(incoming, samples, as_of, limits, order, eligible)
    counts = cardinality(samples, as_of, limits.check_window_hours)
    marked = incoming.join(counts, "metric_id", "left").withColumn(
        "series", F.coalesce("series", F.lit(0).cast("long"))
    )
    full = F.col("series") >= limits.max_series_per_metric
    if limits.at_limit == "strict_all":
        return marked.withColumn("over_limit", full)
    full_metrics = counts.filter(full).select("metric_id")
    known = (
        recent(samples, as_of, limits.check_window_hours)
        .join(full_metrics, "metric_id", "left_semi")
        .select(*SERIES).distinct()
        .withColumn("known", F.lit(True))
    )
    return (
        marked.join(known, SERIES, "left")
        .withColumn("over_limit", full & F.col("known").isNull())
        .drop("known")
    )


def refused_series(fresh: DataFrame, room: DataFrame) -> DataFrame:
    """metric_id, labels_key of the new series that find no place.

    ``fresh`` holds each new series once with its ``first`` arrival, ``room`` the places left by
    metric. Arrivals are ranked without sorting a metric in one task: the series are dealt by
    ranges of (metric, first arrival) and written, each range ranks its own, and the number of a
    metric's series in earlier ranges is added.
    """
    by_range = ["metric_id", "first", "labels_key"]
    dealt = fresh.repartitionByRange(*by_range).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "new-series")
    inside = Window.partitionBy("range", "metric_id").orderBy("first", "labels_key")
    earlier = Window.partitionBy("metric_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("metric_id", "range").count().select(  # one row per metric and range
        "metric_id", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(before, ["metric_id", "range"])
    return ranked.join(room, "metric_id").filter(F.col("before") + F.col("rank") > F.col("room")).select(*SERIES)


def _mark_quota(
    incoming: DataFrame, samples: DataFrame, as_of, limits: CardinalityLimits, order: str, eligible: Column | None
) -> DataFrame:
    most = limits.max_series_per_metric
    known = materialize(recent(samples, as_of, limits.check_window_hours).select(*SERIES).distinct(), "known-series")
    counts = known.groupBy("metric_id").agg(F.count("*").alias("current"))
    asking = incoming if eligible is None else incoming.filter(eligible)
    fresh = asking.groupBy(*SERIES).agg(F.min(order).alias("first")).join(known, SERIES, "left_anti")
    fresh = materialize(fresh, "asking-series")
    wanted = fresh.groupBy("metric_id").agg(F.count("*").alias("wanted"))
    current = F.coalesce("current", F.lit(0).cast("long"))
    state = counts.join(wanted, "metric_id", "full_outer").select(
        "metric_id", F.coalesce("wanted", F.lit(0).cast("long")).alias("wanted"),
        current.alias("current"), F.greatest(F.lit(most) - current, F.lit(0)).alias("room"),
    )
    state = materialize(state, "series-room")
    contested = state.filter(F.col("wanted") > F.col("room")).select("metric_id", "room")
    refused = refused_series(fresh.join(contested.select("metric_id"), "metric_id", "left_semi"), contested)
    series = (F.col("current") + F.least("wanted", "room")).alias("series")
    marked = incoming.join(state.select("metric_id", series), "metric_id", "left").withColumn(
        "series", F.coalesce("series", F.lit(0).cast("long"))
    )
    return marked.join(refused.withColumn("refused", F.lit(True)), SERIES, "left").withColumn(
        "over_limit", F.col("refused").isNotNull() & (F.lit(True) if eligible is None else eligible)
    ).drop("refused")
