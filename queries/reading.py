"""Point, bucket, percentile, statistics and counter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as v
from queries.registry import query
from seriesframe.operators import aggregates, counters
from seriesframe.operators.filters import (
    filter_age, filter_labels, filter_metric, filter_time, filter_time_half_open,
)
from seriesframe.plans import request

LOW = {"band": "low"}
SERIES_ROWS = 5_000_000
GROUP_ROWS = 2_000_000
DENSE_START, DENSE_END = "1993-05-06", "1997-08-09"


# A range that leaves out samples at both ends; the SQL states the same.
FROM, TO = "2024-01-02 03:04:05", "2024-01-27 20:30:00"
_RANGE = f"time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


def _metric(spark, sf_dir, name, labels=None, start=FROM, end=TO):
    found = filter_metric(v.samples(spark, sf_dir), name)
    return filter_labels(filter_time(found, start, end), labels)


# Points


@query("raw_query", views=v.V_SAMPLES, sql="""
SELECT time, round(value + 1e-9, 6) AS value, labels_key FROM v_samples
WHERE metric_id = 'click' AND """ + _RANGE + """
ORDER BY time DESC, labels_key LIMIT 100""")
def raw_query(spark, sf_dir):
    points = request.raw_points(_metric(spark, sf_dir, "click"), 100)
    return v.tidy(points.select("time", "value", "labels_key"))


@query("raw_query_labels", views=v.V_SAMPLES, sql="""
SELECT time, round(value + 1e-9, 6) AS value, labels_key FROM v_samples
WHERE metric_id = 'purchase' AND band = 'low' AND shard = '3' AND """ + _RANGE + """
ORDER BY time DESC, labels_key LIMIT 100""")
def raw_query_labels(spark, sf_dir):
    found = _metric(spark, sf_dir, "purchase", {"shard": "3", "band": "low"})
    return v.tidy(request.raw_points(found, 100).select("time", "value", "labels_key"))


@query("instant", views=v.V_SAMPLES, sql="""
SELECT time, round(value + 1e-9, 6) AS value, labels_key FROM v_samples
WHERE metric_id = 'view' AND time BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'
ORDER BY time DESC, labels_key LIMIT 1""")
def instant(spark, sf_dir):
    found = filter_metric(v.samples(spark, sf_dir), "view")
    point = request.instant(found, "2024-01-15 12:00:00", 86_400)
    return v.tidy(point.select("time", "value", "labels_key"))


@query("instant_per_series", views=v.V_SAMPLES, sql="""
SELECT metric_id, labels_key, max(time) AS time, round(arg_max(value, time) + 1e-9, 6) AS value
FROM v_samples WHERE time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
GROUP BY metric_id, labels_key""")
def instant_per_series(spark, sf_dir):
    found = request.instant_per_series(v.samples(spark, sf_dir), v.AS_OF, 30 * 86_400)
    return v.tidy(found)


@query("range_query", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 6 HOURS, time) AS bucket, round(avg(value) + 1e-9, 6) AS value
FROM v_samples WHERE metric_id = 'signup' AND band = 'low' AND """ + _RANGE + """
GROUP BY 1""")
def range_query(spark, sf_dir):
    found = filter_metric(v.samples(spark, sf_dir), "signup")
    return v.tidy(request.range_query(found, FROM, TO, "6h", LOW))


@query("day_chunks", views=v.V_SAMPLES, sql="""
SELECT 'half_open' AS range, metric_id, count(*) AS samples FROM v_samples
  WHERE time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-20' GROUP BY 2
UNION ALL SELECT 'closed', metric_id, count(*) FROM v_samples
  WHERE time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' GROUP BY 2
UNION ALL SELECT 'older', metric_id, count(*) FROM v_samples
  WHERE time < TIMESTAMP '2024-01-20 06:00:00' GROUP BY 2""")
def day_chunks(spark, sf_dir):
    found = v.with_day(v.samples(spark, sf_dir))
    parts = {
        "half_open": filter_time_half_open(found, "2024-01-03", "2024-01-20"),
        "closed": filter_time(found, "2024-01-03", "2024-01-20"),
        "older": filter_age(found, "2024-01-20 06:00:00"),
    }
    counts = [
        df.groupBy(F.lit(name).alias("range"), "metric_id").agg(F.count(F.lit(1)).alias("samples"))
        for name, df in parts.items()
    ]
    return counts[0].union(counts[1]).union(counts[2])


# Buckets and totals


def _bucket_sql(width: str, metric: str, aggregate: str) -> str:
    return f"""
SELECT time_bucket(INTERVAL {width}, time) AS bucket,
       round(CAST({aggregate} AS DOUBLE) + 1e-9, 6) AS value
FROM v_samples WHERE metric_id = '{metric}' AND {_RANGE} GROUP BY 1"""


@query("bucket_agg_5m", views=v.V_SAMPLES, sql=_bucket_sql("5 MINUTES", "click", "max(value)"))
def bucket_agg_5m(spark, sf_dir):
    return v.tidy(aggregates.bucket_agg(_metric(spark, sf_dir, "click"), 300, "MAX"))


@query("cap_buckets", views=v.V_SAMPLES, sql=_bucket_sql("5 MINUTES", "click", "max(value)") + " ORDER BY 1 DESC LIMIT 1000")
def cap_buckets(spark, sf_dir):
    """The newest thousand buckets, where a caller asks for them."""
    return v.tidy(aggregates.bucket_agg(_metric(spark, sf_dir, "click"), 300, "MAX", 1_000))


@query("bucket_agg_1h", views=v.V_SAMPLES, sql=_bucket_sql("1 HOUR", "click", "avg(value)"))
def bucket_agg_1h(spark, sf_dir):
    return v.tidy(aggregates.bucket_agg(_metric(spark, sf_dir, "click"), 3_600, "AVG"))


@query("bucket_agg_1d", views=v.V_SAMPLES, sql=_bucket_sql("1 DAY", "error", "count(*)"))
def bucket_agg_1d(spark, sf_dir):
    return v.tidy(aggregates.bucket_agg(_metric(spark, sf_dir, "error"), 86_400, "COUNT"))


@query("bucket_agg_7d", views=v.V_DENSE, sql="""
SELECT time_bucket(INTERVAL 7 DAYS, time) AS bucket, round(avg(value) + 1e-9, 6) AS avg_value,
       round(sum(value), 4) AS sum_value, min(value) AS min_value, max(value) AS max_value,
       count(*) AS sample_count
FROM v_dense GROUP BY 1""")
def bucket_agg_7d(spark, sf_dir):
    found = aggregates.bucket_stats(v.dense_samples(spark, sf_dir), 7 * 86_400)
    return v.tidy(aggregates.newest_buckets(found))


@query("bucket_agg_labels", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 7 HOURS, time) AS bucket, round(sum(value), 4) AS sum_value
FROM v_samples WHERE metric_id = 'view' AND band = 'high' AND """ + _RANGE + """ GROUP BY 1""")
def bucket_agg_labels(spark, sf_dir):
    found = _metric(spark, sf_dir, "view", {"band": "high"})
    made = aggregates.bucket_agg(found, 7 * 3_600, "SUM")
    return v.tidy(made.withColumnRenamed("value", "sum_value"))


@query("overall_agg", views=v.V_DENSE, sql="""
SELECT TIMESTAMP '1993-05-06' AS timestamp, round(sum(value), 2) AS value FROM v_dense
WHERE time BETWEEN TIMESTAMP '1993-05-06' AND TIMESTAMP '1997-08-09' HAVING count(*) > 0""")
def overall_agg(spark, sf_dir):
    found = filter_time(v.dense_samples(spark, sf_dir), DENSE_START, DENSE_END)
    made = aggregates.overall_agg(found, DENSE_START, "SUM")
    return v.tidy(made.withColumn("value", F.round("value", 2)))


@query("statistics", views=v.V_DENSE, sql="""
SELECT round(avg(value) + 1e-9, 4) AS avg, round(sum(value), 2) AS sum, min(value) AS min,
       max(value) AS max, count(*) AS count, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50,
       round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(value, 0.99) + 1e-9, 6) AS p99
FROM v_dense""")
def statistics(spark, sf_dir):
    found = aggregates.statistics(v.dense_samples(spark, sf_dir), GROUP_ROWS)
    return v.tidy(found.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round(F.col("avg") + 1e-9, 4)))


# Percentiles


def _percentile(name: str, fraction: float):
    @query(f"percentile_{name}", views=v.V_DENSE, sql=f"""
SELECT TIMESTAMP '1997-08-09' AS timestamp, round(quantile_cont(value, {fraction}) + 1e-9, 6) AS value
FROM v_dense""")
    def percentile(spark, sf_dir):
        found = v.dense_samples(spark, sf_dir)
        return v.tidy(aggregates.percentile(found, DENSE_END, fraction, GROUP_ROWS))


for _name, _fraction in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
    _percentile(_name, _fraction)


@query("percentile_bucketed", views=v.V_DENSE, sql="""
SELECT time_bucket(INTERVAL 30 DAYS, time) AS bucket, round(quantile_cont(value, 0.95) + 1e-9, 6) AS value
FROM v_dense GROUP BY 1""")
def percentile_bucketed(spark, sf_dir):
    found = v.dense_samples(spark, sf_dir)
    return v.tidy(aggregates.percentile_bucketed(found, 30 * 86_400, 0.95, GROUP_ROWS))


@query("percentile_split", views=v.V_DENSE, sql="""
SELECT l_returnflag AS flag, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50,
       round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(value, 0.99) + 1e-9, 6) AS p99
FROM v_dense GROUP BY 1""")
def percentile_split(spark, sf_dir):
    """The way large groups take: sketch bracket, counted slice, distributed rank."""
    from seriesframe.operators.percentiles import exact_percentiles

    found = v.dense_samples(spark, sf_dir).select(F.col("labels")["returnflag"].alias("flag"), "value")
    made = exact_percentiles(found, ["flag"], "value", [0.5, 0.95, 0.99], max_group_rows=1_000)
    points = [F.col("percentiles")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    return v.tidy(made.select("flag", *points))


# Counters

_RATE_SQL = """
SELECT time, metric_id, labels_key, round(rate + 1e-9, 6) AS rate FROM (
  SELECT time, metric_id, labels_key,
    CASE WHEN value < pv THEN value ELSE value - pv END / (epoch_us(time) - epoch_us(pt)) * 1e6 AS rate, pt
  FROM (SELECT *, lag(value) OVER w AS pv, lag(time) OVER w AS pt FROM {source}
        WINDOW w AS (PARTITION BY metric_id, labels_key ORDER BY time)) o) r
WHERE pt IS NOT NULL {extra}"""


def _rates(df):
    return v.tidy(df.select("time", "metric_id", "labels_key", "rate"))


@query("rate", views=v.V_COUNTER, sql=_RATE_SQL.format(source="v_counter", extra=""))
def rate(spark, sf_dir):
    return _rates(counters.rate(v.counter_samples(spark, sf_dir), SERIES_ROWS))


@query("rate_split_series", views=v.V_COUNTER, sql=_RATE_SQL.format(source="v_counter", extra=""))
def rate_split_series(spark, sf_dir):
    """The way overlong series take: calendar slices that hand on their last sample."""
    return _rates(counters.rate(v.counter_samples(spark, sf_dir), max_series_rows=20))


@query("rate_labels", views=v.V_COUNTER, sql=_RATE_SQL.format(
    source="(SELECT * FROM v_counter WHERE metric_id = 'click' AND band = 'low') f",
    extra="ORDER BY time DESC, labels_key LIMIT 100"))
def rate_labels(spark, sf_dir):
    found = filter_metric(filter_labels(v.counter_samples(spark, sf_dir), LOW), "click")
    return _rates(counters.newest_points(counters.rate(found, SERIES_ROWS), 100))


@query("rate_from_start", views=v.V_COUNTER, sql="""
SELECT time, metric_id, labels_key, round(coalesce(
    CASE WHEN value < pv THEN value ELSE value - pv END / (epoch_us(time) - epoch_us(pt)) * 1e6, 0) + 1e-9, 6) AS rate
FROM (SELECT *, lag(value) OVER w AS pv, lag(time) OVER w AS pt FROM v_counter
      WINDOW w AS (PARTITION BY metric_id, labels_key ORDER BY time)) o""")
def rate_from_start(spark, sf_dir):
    return _rates(counters.rate(v.counter_samples(spark, sf_dir), SERIES_ROWS, include_first=True))


@query("rate_from_rollup", views=v.V_COUNTER, sql="""
SELECT bucket AS time, metric_id, labels_key, round(
    CASE WHEN m < pm THEN m ELSE m - pm END / (epoch_us(bucket) - epoch_us(pb)) * 1e6 + 1e-9, 6) AS rate
FROM (SELECT *, lag(m) OVER w AS pm, lag(bucket) OVER w AS pb
      FROM (SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, metric_id, labels_key, max(value) AS m
            FROM v_counter GROUP BY 1, 2, 3) b
      WINDOW w AS (PARTITION BY metric_id, labels_key ORDER BY bucket)) o
WHERE pb IS NOT NULL""")
def rate_from_rollup(spark, sf_dir):
    from seriesframe.operators.rollups import rollup

    return _rates(counters.rate_from_rollup(rollup(v.counter_samples(spark, sf_dir), "1h")))


@query("counter_increase", views=v.V_COUNTER, sql="""
SELECT metric_id, labels_key,
       round(CASE WHEN l >= f THEN l - f ELSE l END + 1e-9, 6) AS total_increase,
       f AS start_value, l AS end_value
FROM (SELECT metric_id, labels_key, arg_min(value, time) AS f, arg_max(value, time) AS l
      FROM v_counter GROUP BY 1, 2) b""")
def counter_increase(spark, sf_dir):
    return v.tidy(counters.counter_increase(v.counter_samples(spark, sf_dir)))


@query("first_last", views=v.V_SAMPLES, sql="""
SELECT metric_id, labels_key, arg_min(value, time) AS start_value, arg_max(value, time) AS end_value
FROM v_samples GROUP BY 1, 2""")
def first_last(spark, sf_dir):
    return v.tidy(counters.first_last(v.samples(spark, sf_dir)))
