"""Queries over corrections: what a refresh of changed buckets gives, and what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import storing
from queries import views as v
from queries.registry import query
from seriesframe.operators import changes, rollups, upsert
from seriesframe.session import materialize

KEY = ["metric_id", "labels_key", "time"]

# Corrections on every day: values lowered, raised and taken back, and samples that come late.
_V_CHANGED = v.V_SAMPLES + """,
v_before AS (
  SELECT time, metric_id, labels_key, value, arrival FROM (
    SELECT *, row_number() OVER (PARTITION BY time, metric_id, labels_key ORDER BY arrival DESC) AS rn
    FROM v_samples) t WHERE rn = 1),
v_fixes AS (
  SELECT time, metric_id, labels_key, CASE WHEN arrival % 60 = 7 THEN NULL
         WHEN arrival % 100 = 0 THEN value / 2 ELSE value + 100 END AS value
  FROM v_before WHERE arrival % 50 = 0 OR arrival % 60 = 7
  UNION ALL
  SELECT time + INTERVAL 1 MICROSECOND, metric_id, labels_key, value * 3 FROM v_before
  WHERE arrival % 75 = 1),
v_after AS (
  SELECT * FROM (SELECT time, metric_id, labels_key, value FROM v_before ANTI JOIN v_fixes
                 USING (time, metric_id, labels_key)
                 UNION ALL SELECT * FROM v_fixes) u WHERE value IS NOT NULL)
"""


def _corrected(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples before, corrections, samples after), all by key."""
    found = v.samples(spark, sf_dir)
    latest = F.max_by(F.struct("value", "arrival"), "arrival").alias("last")
    before = found.groupBy(*KEY).agg(latest).select(*KEY, "last.value", "last.arrival")
    before = materialize(v.with_day(before), "before")
    arrival, value = F.col("arrival"), F.col("value")
    fixed = F.when(arrival % 60 == 7, F.lit(None)).when(arrival % 100 == 0, value / 2).otherwise(value + 100)
    fixes = before.filter((arrival % 50 == 0) | (arrival % 60 == 7)).select(*KEY, fixed.alias("value"))
    late = before.filter(arrival % 75 == 1).select(
        "metric_id", "labels_key", F.timestamp_micros(F.unix_micros("time") + 1).alias("time"), (value * 3).alias("value")
    )
    fixes = materialize(v.with_day(fixes.unionByName(late)), "fixes")
    kept = before.join(fixes.select(*KEY), KEY, "left_anti").select(*KEY, "value", "day")
    after = kept.unionByName(fixes.filter("value IS NOT NULL"))
    return before, fixes, materialize(after, "after")


@query("rollup_refresh_changes", views=_V_CHANGED, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, metric_id, labels_key, round(avg(value) + 1e-9, 6) AS avg_value,
       round(sum(value), 4) AS sum_value, round(min(value) + 1e-9, 6) AS min_value,
       round(max(value) + 1e-9, 6) AS max_value, count(*) AS sample_count
FROM v_after GROUP BY 1, 2, 3""")
def rollup_refresh_changes(spark, sf_dir):
    """Hourly rollups brought up to date by the changed buckets alone."""
    before, fixes, after = _corrected(spark, sf_dir)
    table = materialize(rollups.rollup(before, "1h"), "rollup")
    deltas = materialize(changes.bucket_deltas(changes.sample_changes(before, fixes), "1h"), "deltas")
    return v.tidy(changes.refresh(table, deltas, after, "1h"))


@query("rollup_refresh_reads", views=_V_CHANGED, sql="""
, cells AS (
  SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, metric_id, labels_key, min(value) AS low,
         max(value) AS high, count(*) AS stored FROM v_before GROUP BY 1, 2, 3),
deltas AS (
  SELECT time_bucket(INTERVAL 1 HOUR, f.time) AS bucket, f.metric_id, f.labels_key, min(f.value) AS add_min,
         max(f.value) AS add_max, min(b.value) AS gone_min, max(b.value) AS gone_max,
         count(f.value) - count(b.value) AS more
  FROM v_fixes f LEFT JOIN v_before b USING (time, metric_id, labels_key)
  WHERE f.value IS DISTINCT FROM b.value GROUP BY 1, 2, 3),
again AS (
  SELECT bucket, metric_id, labels_key, stored + more AS rows FROM deltas JOIN cells USING (bucket, metric_id, labels_key)
  WHERE stored + more > 0 AND ((gone_min = low AND coalesce(add_min, 1e300) > low)
                            OR (gone_max = high AND coalesce(add_max, -1e300) < high))),
runs AS (
  SELECT metric_id, CAST(bucket AS DATE) AS day, bucket,
         epoch(bucket) // 3600 - row_number() OVER (PARTITION BY metric_id, CAST(bucket AS DATE) ORDER BY bucket) AS island
  FROM (SELECT DISTINCT metric_id, bucket FROM deltas)),
per_run AS (SELECT day, metric_id, island, count(*) AS n FROM runs GROUP BY ALL)
SELECT day, count(*) AS intervals, sum(n)::BIGINT AS buckets,
       coalesce((SELECT count(*) FROM again WHERE CAST(bucket AS DATE) = day), 0) AS cells_again,
       coalesce((SELECT sum(rows)::BIGINT FROM again WHERE CAST(bucket AS DATE) = day), 0) AS samples_again
FROM per_run GROUP BY day""")
def rollup_refresh_reads(spark, sf_dir):
    """What such a refresh touches, by day: intervals of changed buckets, and samples read again."""
    before, fixes, after = _corrected(spark, sf_dir)
    table = materialize(rollups.rollup(before, "1h"), "rollup")
    deltas = materialize(changes.bucket_deltas(changes.sample_changes(before, fixes), "1h"), "deltas")
    runs = changes.changed_intervals(deltas, "1h").groupBy("day").agg(
        F.count("*").alias("intervals"), F.sum("buckets").alias("buckets")
    )
    cells = changes.lost_extremes(table, deltas)
    again = cells.groupBy(F.to_date("bucket").alias("day")).agg(F.count("*").alias("cells_again"))
    read = changes.samples_of(cells, after, "1h").groupBy("day").agg(F.count("*").alias("samples_again"))
    nothing = F.lit(0).cast("long")
    return runs.join(again, "day", "left").join(read, "day", "left").select(
        "day", "intervals", "buckets", F.coalesce("cells_again", nothing).alias("cells_again"),
        F.coalesce("samples_again", nothing).alias("samples_again"),
    )


@query("store_upsert_refresh", views=v.V_UPSERT, sql="""
SELECT grain, CASE grain WHEN '1h' THEN time_bucket(INTERVAL 1 HOUR, time) ELSE time_bucket(INTERVAL 1 DAY, time) END AS bucket,
       metric_id, labels_key, round(sum(value), 4) AS sum_value, round(min(value) + 1e-9, 6) AS min_value,
       round(max(value) + 1e-9, 6) AS max_value, count(*) AS sample_count, 30 AS complete_days
FROM (SELECT *, max(batch_id) OVER (PARTITION BY time, metric_id, labels_key) AS last FROM v_upsert) u,
     (SELECT unnest(['1h', '1d']) AS grain) g
WHERE batch_id = last GROUP BY 1, 2, 3, 4""")
def store_upsert_refresh(spark, sf_dir):
    """A store whose rollups follow a correcting batch; every day of them stays complete."""
    store = storing._filled(spark, sf_dir)
    store.refresh_rollups()
    store.upsert_and_refresh(v.two_batches(spark, sf_dir).filter("batch_id = 2"), ["arrival"])
    made = None
    for grain in ("1h", "1d"):
        rows = store.rollup(grain).select(
            F.lit(grain).alias("grain"), "bucket", "metric_id", "labels_key", "sum_value", "min_value", "max_value",
            "sample_count", F.lit(len(store.valid_days(grain))).alias("complete_days"),
        )
        made = rows if made is None else made.unionByName(rows)
    return v.tidy(made)
