"""Queries that rollups of several grains, or stored sketches, answer."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from queries import views as v
from queries.registry import query
from seriesframe.operators import cardinality, cover, quantiles, rollups, sketches
from seriesframe.operators.filters import filter_metric
from seriesframe.session import materialize

FROM, TO = "2024-01-02 03:17:11", "2024-01-28 21:44:59"
# Days on which a grain is taken to be out of date.
_STALE = {"1d": {date(2024, 1, 9), date(2024, 1, 10)}, "1h": {date(2024, 1, 10)}}

_TOTAL_SQL = """
SELECT TIMESTAMP '2024-01-02 03:17:11' AS bucket, round(avg(value) + 1e-9, 6) AS avg_value,
       round(sum(value), 4) AS sum_value, round(min(value) + 1e-9, 6) AS min_value,
       round(max(value) + 1e-9, 6) AS max_value, count(*) AS sample_count
FROM v_samples WHERE metric_id = 'view'
  AND time BETWEEN TIMESTAMP '2024-01-02 03:17:11' AND TIMESTAMP '2024-01-28 21:44:59'"""


def _tables(spark, sf_dir):
    """One metric's samples and its rollups of all grains, as tables."""
    found = v.with_day(filter_metric(v.samples(spark, sf_dir), "view"))
    made = {"5m": materialize(rollups.rollup(found, "5m"), "5m")}
    made["1h"] = materialize(rollups.coarsen(made["5m"], "1h"), "1h")
    made["1d"] = materialize(rollups.coarsen(made["1h"], "1d"), "1d")
    return found, made


def _days(stale=()):
    days = {date(2024, 1, 1) + timedelta(days=n) for n in range(30)}
    return {grain: days - _STALE.get(grain, set()) if stale else days for grain in rollups.GRAINS}


@query("cover_total", views=v.V_SAMPLES, sql=_TOTAL_SQL)
def cover_total(spark, sf_dir):
    """A range of weeks as days, then hours, 5 minutes and samples towards both edges."""
    found, made = _tables(spark, sf_dir)
    pieces = cover.range_cover(FROM, TO, made, _days())
    return v.tidy(cover.covered_total(found, made, pieces, FROM))


@query("cover_total_estimated", views=v.V_SAMPLES, sql=_TOTAL_SQL)
def cover_total_estimated(spark, sf_dir):
    """The same with grains left out that save no more rows than a scan costs."""
    found, made = _tables(spark, sf_dir)
    rows = cover.estimate_rows(made)
    pieces = cover.range_cover(FROM, TO, made, _days(), rows_per_day=rows, scan_rows=50)
    return v.tidy(cover.covered_total(found, made, pieces, FROM))


@query("cover_buckets_1d", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 1 DAY, time) AS bucket, round(avg(value) + 1e-9, 6) AS avg_value,
       round(sum(value), 4) AS sum_value, round(min(value) + 1e-9, 6) AS min_value,
       round(max(value) + 1e-9, 6) AS max_value, count(*) AS sample_count
FROM v_samples WHERE metric_id = 'view'
  AND time BETWEEN TIMESTAMP '2024-01-02 03:17:11' AND TIMESTAMP '2024-01-28 21:44:59'
GROUP BY 1""")
def cover_buckets_1d(spark, sf_dir):
    """Daily statistics; days whose daily or hourly rollup is out of date come from finer tables."""
    found, made = _tables(spark, sf_dir)
    pieces = cover.range_cover(FROM, TO, cover.fitting_grains(86_400), _days(stale=True))
    return v.tidy(cover.covered_buckets(found, made, pieces, 86_400))


@query("cardinality_sketch", views=v.V_SAMPLES, sql="""
, hours AS (SELECT DISTINCT metric_id, labels_key, time_bucket(INTERVAL 1 HOUR, time) AS hour FROM v_samples),
sent AS (SELECT DISTINCT metric_id, labels_key, hour + to_hours(CAST(k AS BIGINT)) AS window_end
         FROM hours, range(1, 25) r(k))
SELECT metric_id, window_end, count(*) AS exact_series, TRUE AS within_bound FROM sent GROUP BY 1, 2""")
def cardinality_sketch(spark, sf_dir):
    """Series of every 24-hour window from hourly sketches, held against the exact counts.

    The table of sketches is made of two loads that share samples, as a retried load would.
    """
    found = v.samples(spark, sf_dir)
    first = sketches.hourly_sketches(found.filter("arrival % 3 < 2"))
    again = sketches.hourly_sketches(found.filter("arrival % 3 > 0"))
    table = materialize(sketches.fold(first, again), "sketches")
    guessed = sketches.sliding_series(table)
    exact = cardinality.sliding_cardinality(found)
    return exact.join(guessed, ["metric_id", "window_end"], "full").select(
        "metric_id", "window_end", "exact_series",
        F.coalesce(sketches.within_bound(F.col("series"), F.col("exact_series")), F.lit(False)).alias("within_bound"),
    )


@query("cardinality_sketch_recent", views=v.V_SAMPLES, sql="""
SELECT metric_id, count(DISTINCT labels_key) AS exact_series, TRUE AS within_bound FROM v_samples
WHERE time >= TIMESTAMP '2024-01-29 10:00:00' AND time < TIMESTAMP '2024-01-30 11:00:00' GROUP BY 1""")
def cardinality_sketch_recent(spark, sf_dir):
    """The check window before a moment within an hour, from 25 sketches."""
    found = v.samples(spark, sf_dir)
    table = materialize(sketches.hourly_sketches(found), "sketches")
    guessed = sketches.recent_series(table, "2024-01-30 10:30:00")
    window = found.filter("time >= '2024-01-29 10:00:00' AND time < '2024-01-30 11:00:00'")
    exact = window.groupBy("metric_id").agg(F.countDistinct("labels_key").alias("exact_series"))
    return exact.join(guessed, "metric_id", "full").select(
        "metric_id", "exact_series",
        F.coalesce(sketches.within_bound(F.col("series"), F.col("exact_series")), F.lit(False)).alias("within_bound"),
    )


# Percentiles over sketches


def _by_sketch(samples, key, width):
    """Exact percentiles per key; the sketches are a table, as a store would keep them."""
    table = materialize(quantiles.value_sketches(samples, width, [key]), "value-sketches")
    found = quantiles.percentiles_by_sketch(samples, table, [0.5, 0.95, 0.99], width, [key])
    points = [F.col("percentiles")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    return v.tidy(found.select(key, *points))


@query("percentile_by_sketch", views=v.V_DENSE, sql="""
SELECT l_returnflag AS flag, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50,
       round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(value, 0.99) + 1e-9, 6) AS p99
FROM v_dense GROUP BY 1""")
def percentile_by_sketch(spark, sf_dir):
    """Values that do not follow time: every bucket straddles, only the slice is shuffled."""
    rows = v.dense_samples(spark, sf_dir).withColumn("flag", F.col("labels")["returnflag"])
    return _by_sketch(rows, "flag", 30 * 86_400)


@query("percentile_by_sketch_counter", views=v.V_COUNTER, sql="""
SELECT metric_id, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50,
       round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(value, 0.99) + 1e-9, 6) AS p99
FROM v_counter GROUP BY 1""")
def percentile_by_sketch_counter(spark, sf_dir):
    """Values that grow with time: buckets below a bracket are counted unread."""
    return _by_sketch(v.counter_samples(spark, sf_dir), "metric_id", 900)
