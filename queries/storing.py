"""Queries over stored tables: upsert, archive, lifecycle, files and streams.

Each one builds its own store in a fresh folder, runs the job over the whole table and returns
what it reads back.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import views as v
from queries.registry import query
from seriesframe.config import Settings
from seriesframe.functions.labels import canonical_key
from seriesframe.operators import archive, lifecycle, postings, upsert
from seriesframe.operators.filters import filter_metric
from seriesframe.plans.request import Aggregation, QueryRequest, raw_points
from seriesframe.plans.store import SeriesStore
from seriesframe.schema import ROLLUP, SAMPLES
from seriesframe.session import scratch_path
from seriesframe.sources import export, tables
from seriesframe.sources.archive import read_archive_days
from seriesframe.sources.samples import read_samples_json, read_samples_ndjson
from seriesframe.streaming.ingest import dedup_first_wins, start, stream_ingest
from seriesframe.streaming.rates import current_rates, stream_rate
from seriesframe.streaming.rollups import write_stream_rollup

CUTOFF = date(2024, 1, 11)
KEY_VALUE = ["time", "metric_id", "labels_key", "value"]


def _bare(spark: SparkSession, **settings) -> SeriesStore:
    return SeriesStore(spark, scratch_path(spark, "store"), Settings(**settings))


def _store(spark: SparkSession, sf_dir: str, **settings) -> SeriesStore:
    """A store holding the metric dimension."""
    store = _bare(spark, **settings)
    tables.replace_table(v.metrics(spark, sf_dir), store.path("metrics"))
    tables.replace_table(v.metric_labels(spark, sf_dir), store.path("metric_labels"))
    return store


def _filled(spark: SparkSession, sf_dir: str, named: bool = False, **settings) -> SeriesStore:
    """A store holding all event samples, with the metric dimension where names are looked up."""
    store = _store(spark, sf_dir, **settings) if named else _bare(spark, **settings)
    rows = v.with_day(v.samples(spark, sf_dir)).select(*SAMPLES.names)
    tables.append_days(rows, store.path("samples"))
    return store


# Upsert

_LAST = """
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY time, metric_id, labels_key ORDER BY {order}) AS rn
  FROM {source}) t WHERE rn = 1"""


@query("upsert", views=v.V_UPSERT, sql=_LAST.format(order="batch_id DESC", source="v_upsert"))
def upsert_query(spark, sf_dir):
    store = _bare(spark)
    rows = v.two_batches(spark, sf_dir)
    for number in (1, 2):
        store.upsert_samples(rows.filter(F.col("batch_id") == number), ["arrival"])
    return v.tidy(store.samples().select(*KEY_VALUE))


@query("upsert_dense", views=v.V_DENSE, sql=_LAST.format(
    order="l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, value DESC",
    source="v_dense"))
def upsert_dense(spark, sf_dir):
    rows = upsert.last_wins(v.dense_samples(spark, sf_dir), v.DENSE_ORDER)
    return v.tidy(upsert.as_samples(rows).select(*KEY_VALUE))


@query("scan_samples", views=v.V_SAMPLES, sql="""
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value FROM v_samples
WHERE metric_id = 'click' AND time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'
  AND band = 'low'""")
def scan_samples(spark, sf_dir):
    store = _filled(spark, sf_dir)
    found = store.samples("click", "2024-01-05 06:00:00", "2024-01-20 18:00:00", {"band": "low"})
    return v.tidy(found.select(*KEY_VALUE))


@query("ingest", views=v.V_DIRTY, sql="""
SELECT time, name, round(value + 1e-9, 6) AS value,
       '{"' || list_sort(ks)[1] || '":"' || vs[list_position(ks, list_sort(ks)[1])] || '","'
            || list_sort(ks)[2] || '":"' || vs[list_position(ks, list_sort(ks)[2])] || '"}' AS labels_key
FROM v_validated WHERE reason IS NULL""")
def ingest(spark, sf_dir):
    """Validate, register, land and merge a batch, then read the store."""
    store = _store(spark, sf_dir)
    kept = v.metrics(spark, sf_dir).filter(F.col("name") != "error")
    tables.replace_table(kept, store.path("metrics"))
    store.ingest(v.dirty_samples(spark, sf_dir), v.AS_OF, batch="b1")
    store.merge_incoming()
    found = store.samples().join(store.metrics().select(F.col("id").alias("metric_id"), "name"), "metric_id")
    return v.tidy(found.select("time", "name", "value", "labels_key"))


@query("store_query", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS timestamp, round(avg(value) + 1e-9, 6) AS value,
       '{"band":"low"}' AS labels
FROM v_samples WHERE metric_id = 'click' AND band = 'low'
  AND time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY 1""")
def store_query(spark, sf_dir):
    """A request object against a store: hourly average with a label filter."""
    request = QueryRequest("click", v.START, v.AS_OF, {"band": "low"}, Aggregation.AVG, "1h")
    found = _filled(spark, sf_dir, named=True).query(request, v.AS_OF)
    return v.tidy(found.withColumn("labels", F.to_json("labels")))


# Archive


def _old_manifest(spark, sf_dir) -> DataFrame:
    """Manifest of all days before the cutoff, with a stand-in for file sizes."""
    old = v.with_day(v.samples(spark, sf_dir)).filter(F.col("day") < F.lit(CUTOFF))
    rows = archive.manifest_rows(archive.labels_index(old), v.AS_OF)
    return rows.withColumn("file_size_bytes", F.col("row_count") * 100)


V_MANIFEST = v.V_SAMPLES + """,
v_manifest AS (
  SELECT metric_id, day, CAST(day AS TIMESTAMP) AS start_time,
         CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS end_time, count(*) AS row_count,
         count(DISTINCT labels_key) AS series_count, count(*) * 100 AS file_size_bytes,
         'parquet/day=' || CAST(day AS VARCHAR) || '/metric_id=' || metric_id AS storage_path
  FROM v_samples WHERE day < DATE '2024-01-11' GROUP BY metric_id, day)
"""
_MANIFEST = "metric_id, day, start_time, end_time, row_count, series_count, storage_path"


def _manifest(df: DataFrame) -> DataFrame:
    return v.tidy(df.select(*_MANIFEST.split(", ")))


@query("archive_candidates", views=V_MANIFEST, sql="""
SELECT metric_id, day, count(*) AS row_count FROM v_samples
WHERE day < DATE '2024-01-21' AND day >= DATE '2024-01-11' GROUP BY 1, 2""")
def archive_candidates(spark, sf_dir):
    found = v.with_day(v.samples(spark, sf_dir))
    return archive.archive_candidates(found, _old_manifest(spark, sf_dir), date(2024, 1, 21))


@query("archive_manifest", views=V_MANIFEST, sql=f"SELECT {_MANIFEST} FROM v_manifest")
def archive_manifest(spark, sf_dir):
    store = _filled(spark, sf_dir, archive_after_days=20)
    store.archive(v.AS_OF)
    return _manifest(store.manifest().filter("file_size_bytes > 0"))


@query("archive_hot_rest", views=v.V_SAMPLES, sql="""
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value FROM v_samples
WHERE day >= DATE '2024-01-11'""")
def archive_hot_rest(spark, sf_dir):
    """What stays in the hot table after archiving twice."""
    store = _filled(spark, sf_dir, archive_after_days=20)
    store.archive(v.AS_OF)
    store.archive(v.AS_OF)
    return v.tidy(store.samples().select(*KEY_VALUE))


@query("archive_read", views=v.V_SAMPLES, sql="""
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value FROM v_samples
WHERE metric_id = 'error' AND day < DATE '2024-01-11'
  AND time BETWEEN TIMESTAMP '2024-01-02 10:00:00' AND TIMESTAMP '2024-01-20'""")
def archive_read(spark, sf_dir):
    store = _filled(spark, sf_dir, archive_after_days=20)
    store.archive(v.AS_OF, "json.gz")
    found = store.read_archive("error", "2024-01-02 10:00:00", "2024-01-20 00:00:00")
    return v.tidy(found.select(*KEY_VALUE))


@query("unified_scan", views=v.V_SAMPLES, sql="""
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value FROM v_samples WHERE metric_id = 'signup'
  AND time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'""")
def unified_scan(spark, sf_dir):
    """Hot and archived samples together are the samples before archiving."""
    store = _filled(spark, sf_dir, named=True, archive_after_days=20)
    store.archive(v.AS_OF)
    return v.tidy(store.unified_samples("signup", v.START, v.AS_OF).select(*KEY_VALUE))


@query("unified_overlap", views=v.V_UPSERT, sql=_LAST.format(order="batch_id DESC", source="v_upsert"))
def unified_overlap(spark, sf_dir):
    """Where both tiers hold a sample the hot value counts."""
    rows = v.two_batches(spark, sf_dir)
    cold, hot = (rows.filter(F.col("batch_id") == n).select(*KEY_VALUE) for n in (1, 2))
    return v.tidy(archive.unified_scan(hot, cold))


_IN_MONTH = "time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"


def _half_archived(spark, sf_dir, change=None) -> SeriesStore:
    """A store with the older days in the archive; ``change`` may alter its samples before."""
    store = _store(spark, sf_dir, archive_after_days=20)
    rows = v.with_day(v.samples(spark, sf_dir))
    rows = rows if change is None else change(rows)
    tables.append_days(rows.select(*SAMPLES.names), store.path("samples"))
    store.archive(v.AS_OF)
    return store


@query("unified_query", views=v.V_SAMPLES, sql=f"""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS timestamp, round(avg(value) + 1e-9, 6) AS value
FROM v_samples WHERE metric_id = 'click' AND {_IN_MONTH} GROUP BY 1""")
def unified_query(spark, sf_dir):
    """An aggregation over hot and archived days."""
    request = QueryRequest("click", v.START, v.AS_OF, {}, Aggregation.AVG, "1h")
    return v.tidy(_half_archived(spark, sf_dir).query(request, v.AS_OF).drop("labels"))


_SPARSE = "(shard <> '3' OR day(day) % 3 = 0)"


def _sparse_label(spark, sf_dir) -> SeriesStore:
    """A half archived store in which one label value occurs on every third day only."""
    return _half_archived(spark, sf_dir, lambda rows: rows.filter(
        (F.col("labels")["shard"] != "3") | (F.dayofmonth("day") % 3 == 0)
    ))


@query("archive_read_labels", views=v.V_SAMPLES, sql=f"""
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value FROM v_samples
WHERE metric_id = 'view' AND day < DATE '2024-01-11' AND shard = '3' AND band = 'low' AND {_SPARSE}""")
def archive_read_labels(spark, sf_dir):
    """An archive read by labels; it opens the files of every third day."""
    found = _sparse_label(spark, sf_dir).read_archive("view", v.START, v.AS_OF, {"shard": "3", "band": "low"})
    return v.tidy(found.select(*KEY_VALUE))


@query("archive_label_days", views=v.V_SAMPLES, sql=f"""
SELECT metric_id, CAST(day AS DATE) AS day FROM v_samples WHERE day < DATE '2024-01-11' AND {_SPARSE}
GROUP BY 1, 2 HAVING bool_or(shard = '3') AND bool_or(band = 'low')""")
def archive_label_days(spark, sf_dir):
    """The archived (metric, day) files that such a read of any metric would open."""
    store = _sparse_label(spark, sf_dir)
    return postings.days_with(store.manifest(), store.postings(), {"shard": "3", "band": "low"}).select("metric_id", "day")


@query("unified_statistics", views=v.V_SAMPLES, sql=f"""
SELECT round(avg(value) + 1e-9, 4) AS avg, round(sum(value), 2) AS sum, min(value) AS min,
       max(value) AS max, count(*) AS count, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50,
       round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(value, 0.99) + 1e-9, 6) AS p99
FROM v_samples WHERE metric_id = 'view' AND {_IN_MONTH}""")
def unified_statistics(spark, sf_dir):
    found = _half_archived(spark, sf_dir).statistics("view", v.AS_OF, v.START, v.AS_OF)
    return v.tidy(found.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round(F.col("avg") + 1e-9, 4)))


@query("unified_rate", views=v.V_COUNTER, sql=f"""
SELECT time, metric_id, labels_key, round(
    CASE WHEN value < pv THEN value ELSE value - pv END / (epoch_us(time) - epoch_us(pt)) * 1e6 + 1e-9, 6) AS rate
FROM (SELECT *, lag(value) OVER w AS pv, lag(time) OVER w AS pt FROM v_counter
      WHERE metric_id = 'signup' AND {_IN_MONTH}
      WINDOW w AS (PARTITION BY metric_id, labels_key ORDER BY time)) o
WHERE pt IS NOT NULL""")
def unified_rate(spark, sf_dir):
    """Counter rates that continue over the border of the archive."""
    store = _half_archived(
        spark, sf_dir, lambda rows: v.with_day(v.counter_samples(spark, sf_dir))
    )
    found = store.counter_rate("signup", v.START, v.AS_OF)
    return v.tidy(found.select("time", "metric_id", "labels_key", "rate"))


@query("store_routed", views=v.V_UPSERT, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS timestamp, round(CAST(sum(value) AS DOUBLE), 4) AS sum_value FROM (
  SELECT *, max(batch_id) OVER (PARTITION BY time, metric_id, labels_key) AS last FROM v_upsert) u
WHERE metric_id = 'view' AND time BETWEEN TIMESTAMP '2024-01-02 03:17:11' AND TIMESTAMP '2024-01-28 21:44:59'
  AND batch_id = CASE WHEN time >= TIMESTAMP '2024-01-20' THEN last ELSE 1 END
GROUP BY 1""")
def store_routed(spark, sf_dir):
    """Rollups, then corrections of the later days and the archiving of the earlier ones."""
    store = _filled(spark, sf_dir, named=True, archive_after_days=20)
    store.refresh_rollups()
    second = v.two_batches(spark, sf_dir).filter("batch_id = 2 AND time >= '2024-01-20'")
    store.upsert_samples(second, ["arrival"])
    store.archive(v.AS_OF)
    request = QueryRequest("view", "2024-01-02 03:17:11", "2024-01-28 21:44:59", {}, Aggregation.SUM, "1h")
    found = store.routed_query(request, v.AS_OF, scan_rows=0).drop("labels")
    return v.tidy(found.withColumnRenamed("value", "sum_value"))


@query("archive_late", views=v.V_UPSERT, sql=_LAST.format(
    order="batch_id DESC", source="(SELECT * FROM v_upsert WHERE time < TIMESTAMP '2024-01-11') u"))
def archive_late(spark, sf_dir):
    """Corrections of archived days are folded into the archive; hot keeps nothing of them."""
    store = _filled(spark, sf_dir, named=True, archive_after_days=20)
    store.archive(v.AS_OF)
    second = v.two_batches(spark, sf_dir).filter("batch_id = 2 AND time < '2024-01-11'")
    store.upsert_samples(second, ["arrival"])
    store.archive(v.AS_OF)
    days = tables.days_of(spark, store.path("manifest"))
    cold = read_archive_days(spark, store.path("archive"), store.manifest(), days)
    left = store.samples().filter(F.col("day") < F.lit(CUTOFF))
    return v.tidy(cold.unionByName(left).select(*KEY_VALUE))


@query("store_metric_update", views=v.V_METRICS, sql="""
SELECT id, CASE WHEN id = 'click' THEN 90 ELSE retention_days END AS retention_days,
       CASE WHEN id = 'view' THEN false ELSE is_active END AS is_active FROM v_metrics""")
def store_metric_update(spark, sf_dir):
    """The catalogue after two changes in place."""
    store = _store(spark, sf_dir)
    store.update_metric("click", v.AS_OF, retention_days=90)
    store.deactivate_metric("view", v.AS_OF)
    return store.metrics().select("id", "retention_days", "is_active")


@query("store_register", views=v.V_REGISTRATIONS, sql="""
SELECT name, type, retention_days FROM v_registered WHERE reason IS NULL
UNION ALL SELECT event_type, CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'COUNTER' ELSE 'GAUGE' END,
  CASE WHEN event_type IN ('click', 'signup', 'view') THEN 10 ELSE 20 END FROM (SELECT DISTINCT event_type FROM events) e""")
def store_register(spark, sf_dir):
    """Accepted registrations appended to a catalogue; sent twice, they count once."""
    store = _store(spark, sf_dir)
    for _ in range(2):
        store.register(v.registrations(spark, sf_dir), v.AS_OF)
    return store.metrics().select("name", "type", "retention_days")


@query("store_purge", views=V_MANIFEST, sql=f"""
SELECT {_MANIFEST} FROM v_manifest WHERE day >= DATE '2024-01-06'""")
def store_purge(spark, sf_dir):
    """Two archive runs; the manifest rows that the first one created are purged."""
    store = _filled(spark, sf_dir, archive_after_days=20)
    store.archive("2024-01-26")
    store.archive(v.AS_OF)
    store.purge_manifest("2024-01-28")
    return _manifest(store.manifest())


@query("ingest_totals", views=v.V_DIRTY, sql="""
SELECT CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS total_accepted,
       CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS total_rejected FROM v_validated""")
def ingest_totals(spark, sf_dir):
    """Running totals over three batches, one of them sent twice."""
    store = _store(spark, sf_dir)
    tables.replace_table(store.metrics().filter("name <> 'error'"), store.path("metrics"))
    for number in (0, 1, 2, 1):
        part = v.dirty_samples(spark, sf_dir).filter(F.col("idx") % 3 == number)
        store.ingest(part, v.AS_OF, batch=f"part-{number}").release()
    return store.ingest_totals()


@query("labels_index", views=v.V_SAMPLES, sql="""
SELECT metric_id, day, labels_key, count(*) AS row_count FROM v_samples
WHERE day < DATE '2024-01-11' GROUP BY 1, 2, 3""")
def labels_index(spark, sf_dir):
    old = v.with_day(v.samples(spark, sf_dir)).filter(F.col("day") < F.lit(CUTOFF))
    return archive.labels_index(old)


@query("archive_stats", views=V_MANIFEST, sql="""
SELECT metric_id, count(*) AS file_count, CAST(sum(row_count) AS BIGINT) AS total_rows,
       CAST(sum(file_size_bytes) AS BIGINT) AS total_size FROM v_manifest GROUP BY 1""")
def archive_stats(spark, sf_dir):
    return archive.archive_stats(_old_manifest(spark, sf_dir))


@query("archive_totals", views=V_MANIFEST, sql="""
SELECT count(DISTINCT metric_id) AS metrics_archived, CAST(sum(row_count) AS BIGINT) AS total_rows,
       round(sum(file_size_bytes) / (1024.0 * 1024 * 1024) + 1e-9, 6) AS total_gb FROM v_manifest""")
def archive_totals(spark, sf_dir):
    return v.tidy(archive.archive_totals(_old_manifest(spark, sf_dir)))


@query("archive_lag", views=v.V_SAMPLES, sql="""
SELECT min(time) AS oldest,
       round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(time))) / 1e6 + 1e-9, 6) AS age_seconds FROM v_samples""")
def archive_lag(spark, sf_dir):
    return v.tidy(archive.archive_lag(v.samples(spark, sf_dir), v.AS_OF))


@query("metrics_before", views=V_MANIFEST, sql="""
SELECT 'hot' AS side, metric_id FROM (SELECT DISTINCT metric_id FROM v_samples WHERE time < TIMESTAMP '2024-01-11') h
UNION ALL SELECT 'archived', metric_id FROM (SELECT DISTINCT metric_id FROM v_manifest) a""")
def metrics_before(spark, sf_dir):
    hot = archive.metrics_before(v.samples(spark, sf_dir), "2024-01-11")
    cold = archive.archived_metrics(_old_manifest(spark, sf_dir))
    return hot.select(F.lit("hot").alias("side"), "metric_id").union(
        cold.select(F.lit("archived").alias("side"), "metric_id")
    )


@query("recent_archives", views=V_MANIFEST, sql=f"""
SELECT {_MANIFEST} FROM v_manifest WHERE metric_id = 'click' ORDER BY start_time DESC LIMIT 10""")
def recent_archives(spark, sf_dir):
    return _manifest(archive.recent_archives(_old_manifest(spark, sf_dir), "click"))


@query("manifest_overlap", views=V_MANIFEST, sql=f"""
SELECT {_MANIFEST} FROM v_manifest WHERE metric_id = 'view'
  AND start_time <= TIMESTAMP '2024-01-08 09:00:00' AND end_time >= TIMESTAMP '2024-01-03'""")
def manifest_overlap(spark, sf_dir):
    manifest = _old_manifest(spark, sf_dir)
    return _manifest(archive.manifest_overlap(manifest, "view", "2024-01-03", "2024-01-08 09:00:00"))


@query("manifest_for_ranges", views=V_MANIFEST, sql="""
SELECT e.event_id AS query_id, count(*) AS files, CAST(sum(m.row_count) AS BIGINT) AS row_count
FROM events e JOIN v_manifest m ON m.metric_id = e.event_type
  AND m.start_time <= e.ts AND m.end_time >= e.ts - INTERVAL 36 HOUR
GROUP BY 1""")
def manifest_for_ranges(spark, sf_dir):
    """One range per event: the 36 hours before it."""
    ranges = v.samples(spark, sf_dir).select(
        F.col("arrival").alias("query_id"), "metric_id",
        (F.col("time") - F.expr("INTERVAL 36 HOURS")).alias("start"), F.col("time").alias("end"),
    )
    found = archive.manifest_for_ranges(_old_manifest(spark, sf_dir), ranges)
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("row_count")
    )


@query("manifest_for_long_ranges", views=V_MANIFEST, sql="""
SELECT e.event_id AS query_id, count(*) AS files, CAST(sum(m.row_count) AS BIGINT) AS row_count
FROM events e JOIN v_manifest m ON m.metric_id = e.event_type
  AND m.start_time <= e.ts + to_hours(e.event_id % 90000) AND m.end_time >= e.ts - to_hours(e.event_id % 70000)
GROUP BY 1""")
def manifest_for_long_ranges(spark, sf_dir):
    """One range per event, from hours to eighteen years long."""
    span = F.col("arrival") % 70_000, F.col("arrival") % 90_000
    start, end = (
        F.timestamp_micros(F.unix_micros("time") + sign * hours * 3_600_000_000) for sign, hours in zip((-1, 1), span)
    )
    ranges = v.samples(spark, sf_dir).select(
        F.col("arrival").alias("query_id"), "metric_id", start.alias("start"), end.alias("end")
    )
    found = archive.manifest_for_ranges(_old_manifest(spark, sf_dir), ranges)
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("row_count")
    )


@query("purge_manifest", views=V_MANIFEST, sql=f"""
SELECT {_MANIFEST} FROM v_manifest WHERE start_time + INTERVAL 20 DAY >= TIMESTAMP '2024-01-26'""")
def purge_manifest(spark, sf_dir):
    """Rows created twenty days after their day, purged by creation time."""
    manifest = _old_manifest(spark, sf_dir).withColumn(
        "created_at", F.col("start_time") + F.expr("INTERVAL 20 DAYS")
    )
    return _manifest(archive.purge_manifest(manifest, "2024-01-26"))


# Lifecycle


@query("retention", views=v.V_SAMPLES + "," + v.V_METRICS, sql="""
SELECT time, metric_id, labels_key, round(value + 1e-9, 6) AS value
FROM v_samples s JOIN v_metrics m ON s.metric_id = m.id
WHERE time >= TIMESTAMP '2024-01-31' - to_days(retention_days)""")
def retention(spark, sf_dir):
    store = _filled(spark, sf_dir, named=True, default_retention_days=20)
    store.apply_retention(v.AS_OF)
    return v.tidy(store.samples().select(*KEY_VALUE))


@query("expired_samples", views=v.V_SAMPLES + "," + v.V_METRICS, sql="""
SELECT metric_id, count(*) AS samples FROM v_samples s JOIN v_metrics m ON s.metric_id = m.id
WHERE time < TIMESTAMP '2024-01-31' - to_days(retention_days) GROUP BY 1""")
def expired_samples(spark, sf_dir):
    old = lifecycle.expired(v.samples(spark, sf_dir), v.metrics(spark, sf_dir), v.AS_OF)
    return old.groupBy("metric_id").agg(F.count(F.lit(1)).alias("samples"))


@query("run_log", views=V_MANIFEST, sql="""
SELECT 'archive' AS job_type, 'COMPLETED' AS status, CAST(count(DISTINCT metric_id) AS INTEGER) AS metrics_processed,
       CAST(sum(row_count) AS BIGINT) AS rows_migrated FROM v_manifest""")
def run_log(spark, sf_dir):
    """The row that an archive job over the whole table leaves."""
    store = _filled(spark, sf_dir, archive_after_days=20)
    store.archive(v.AS_OF)
    return store.runs().select("job_type", "status", "metrics_processed", "rows_migrated")


@query("rollup_refresh_band", views=v.V_UPSERT, sql="""
SELECT CAST(CAST(time AS DATE) AS TIMESTAMP) AS bucket, metric_id, labels_key, round(sum(value), 4) AS sum_value,
       round(max(value) + 1e-9, 6) AS max_value, count(*) AS sample_count
FROM (SELECT *, max(batch_id) OVER (PARTITION BY time, metric_id, labels_key) AS last FROM v_upsert) u
WHERE batch_id = CASE WHEN time >= TIMESTAMP '2024-01-24' AND time < TIMESTAMP '2024-01-29' THEN last ELSE 1 END
GROUP BY 1, 2, 3""")
def rollup_refresh_band(spark, sf_dir):
    """Daily rollups, corrected samples, then a refresh that touches only its band."""
    store = _filled(spark, sf_dir)
    store.refresh_rollups()
    second = v.two_batches(spark, sf_dir).filter("batch_id = 2")
    store.upsert_samples(second, ["arrival"])
    store.refresh_band("1d", "2024-01-30 12:00:00")
    return v.tidy(store.rollup("1d").select(
        "bucket", "metric_id", "labels_key", "sum_value", "max_value", "sample_count"
    ))


# Files


def _points(spark, sf_dir) -> DataFrame:
    found = raw_points(filter_metric(v.samples(spark, sf_dir), "click"), None)
    return found.select(F.col("time").alias("timestamp"), "value", "labels")


def _exported(spark, sf_dir, kind: str) -> str:
    path = scratch_path(spark, "export")
    export.export(_points(spark, sf_dir), "click", kind, path)
    return path


_NEWEST = "v_samples WHERE metric_id = 'click'"
_ISO = "strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ')"


@query("export_json", views=v.V_SAMPLES, sql=f"""
SELECT {_ISO} AS timestamp, metric_id AS metric, value, labels_key AS labels FROM {_NEWEST}""")
def export_json(spark, sf_dir):
    back = spark.read.schema("timestamp string, metric string, value double, labels map<string,string>").json(
        _exported(spark, sf_dir, "JSON")
    )
    return back.withColumn("labels", canonical_key("labels"))


@query("export_csv", views=v.V_SAMPLES, sql=f"""
SELECT {_ISO} AS timestamp, metric_id AS metric, value, labels_key AS labels FROM {_NEWEST}""")
def export_csv(spark, sf_dir):
    schema = "timestamp string, metric string, value double, labels string"
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.csv(_exported(spark, sf_dir, "CSV"))


@query("export_prometheus", views=v.V_SAMPLES, sql=f"""
SELECT 'click{{band="' || band || '",shard="' || shard || '"}} ' || CAST(value AS VARCHAR) || ' '
       || CAST(epoch_us(time) // 1000 AS VARCHAR) AS line FROM {_NEWEST}""")
def export_prometheus(spark, sf_dir):
    return spark.read.text(_exported(spark, sf_dir, "PROMETHEUS")).withColumnRenamed("value", "line")


def _sample_json() -> F.Column:
    iso = F.date_format("timestamp", export.ISO).alias("timestamp")
    return F.struct("name", "value", iso, "labels", "type")


@query("read_ndjson", views=v.V_DIRTY, sql="""
SELECT row_number() OVER (PARTITION BY idx % 4 ORDER BY idx) - 1 AS idx,
       CASE WHEN kind = 39 THEN '{"name": "' || event_type ELSE name END AS name,
       CASE WHEN kind < 39 THEN time END AS timestamp,
       CASE WHEN kind < 39 AND NOT isnan(value) AND NOT isinf(value) THEN round(value, 6) END AS value,
       CASE WHEN kind = 39 THEN 'malformed' END AS problem
FROM v_dirty""")
def read_ndjson(spark, sf_dir):
    """Four files of lines, each line with its position in its file."""
    path = scratch_path(spark, "ndjson")
    rows = v.dirty_samples(spark, sf_dir)
    broken = F.concat(F.lit('{"name": "'), "name")
    line = F.when(F.col("idx") % 40 == 39, broken).otherwise(F.to_json(_sample_json()))
    lines = rows.select(line.alias("line"), (F.col("idx") % 4).alias("part"), "idx")
    lines = lines.repartition("part").sortWithinPartitions("part", "idx").drop("idx")
    lines.write.partitionBy("part").text(path)
    back = read_samples_ndjson(spark, path)
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return v.tidy(back.select(
        "idx", "name", "timestamp", F.when(finite, F.col("value")).alias("value"), "problem"
    ))


def _by_arrival(left, right):
    return (left["arrival"] - right["arrival"]).cast("int")


@query("read_json_batch", views=v.V_SAMPLES, sql="""
SELECT CAST(arrival % 1000 AS BIGINT) AS idx, metric_id AS name, time AS timestamp, round(value + 1e-9, 6) AS value, labels_key
FROM v_samples""")
def read_json_batch(spark, sf_dir):
    """Every event posted in requests of a thousand samples, one file per request."""
    path = scratch_path(spark, "batches")
    iso = F.date_format("time", export.ISO).alias("timestamp")
    one = F.struct("arrival", F.col("metric_id").alias("name"), "value", iso, "labels")
    requests = (
        v.samples(spark, sf_dir).withColumn("request", F.floor(F.col("arrival") / 1_000))
        .groupBy("request").agg(F.array_sort(F.collect_list(one), _by_arrival).alias("metrics"))
        .withColumn("metrics", F.transform("metrics", lambda m: m.dropFields("arrival")))
    )
    requests.select("request", F.to_json(F.struct("metrics")).alias("body")).write.partitionBy(
        "request"
    ).text(path)
    back = read_samples_json(spark, f"{path}/*/", max_batch=10_000)
    return v.tidy(back.select(
        "idx", "name", "timestamp", "value", canonical_key("labels").alias("labels_key")
    ))


# Streams


def _clock() -> datetime:
    return datetime(2024, 1, 31, tzinfo=timezone.utc)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = v.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return v.event_samples(raw)


@query("stream_ingest", views=v.V_DIRTY, sql="""
SELECT name, time, round(value + 1e-9, 6) AS value FROM v_validated WHERE reason IS NULL""")
def stream_ingest_query(spark, sf_dir):
    store = _store(spark, sf_dir)
    kept = v.metrics(spark, sf_dir).filter(F.col("name") != "error")
    tables.replace_table(kept, store.path("metrics"))
    lines = scratch_path(spark, "lines")
    v.dirty_samples(spark, sf_dir).select(F.to_json(_sample_json())).write.text(lines)
    stream_ingest(
        store, lines, scratch_path(spark, "checkpoint"), clock=_clock, available_now=True
    ).awaitTermination()
    found = store.samples().join(store.metrics().select(F.col("id").alias("metric_id"), "name"), "metric_id")
    return v.tidy(found.select("name", "time", "value"))


@query("stream_rollup", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, metric_id, labels_key, round(avg(value) + 1e-9, 6) AS avg_value,
       round(sum(value), 4) AS sum_value, min(value) AS min_value, max(value) AS max_value, count(*) AS sample_count
FROM v_samples GROUP BY 1, 2, 3
HAVING epoch_ms(time_bucket(INTERVAL 1 HOUR, time)) + 3600000
       <= (SELECT epoch_ms(max(time)) FROM v_samples) - 3 * 3600000""")
def stream_rollup(spark, sf_dir):
    """Closed hours only: append mode withholds buckets the watermark has not passed."""
    path = scratch_path(spark, "stream-rollup")
    write_stream_rollup(
        _event_stream(spark, sf_dir), "1h", path, scratch_path(spark, "checkpoint"), available_now=True
    ).awaitTermination()
    return v.tidy(tables.read_table(spark, path, ROLLUP).drop("day"))


@query("stream_then_refresh", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, metric_id, labels_key,
       round(sum(value), 4) AS sum_value, count(*) AS sample_count
FROM v_samples GROUP BY 1, 2, 3""")
def stream_then_refresh(spark, sf_dir):
    """Rollups streamed in two arrivals, the earlier samples last and so too late for the
    watermark; a refresh of the same table then corrects it."""
    store = _filled(spark, sf_dir)
    arrived, checkpoint = scratch_path(spark, "arrived"), scratch_path(spark, "checkpoint")
    rows = v.samples(spark, sf_dir).select(*KEY_VALUE)
    for part in (rows.filter("time >= '2024-01-05'"), rows.filter("time < '2024-01-05'")):
        part.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(rows.schema).parquet(arrived)
        write_stream_rollup(
            stream, "1h", store.path("rollup_1h"), checkpoint, available_now=True
        ).awaitTermination()
    store.refresh_rollups()
    return v.tidy(store.rollup("1h").select("bucket", "metric_id", "labels_key", "sum_value", "sample_count"))


_STREAM_RATE_SQL = """
SELECT time, metric_id, labels_key, round(
    CASE WHEN value < pv THEN value ELSE value - pv END / (epoch_us(time) - epoch_us(pt)) * 1e6 + 1e-9, 6) AS rate
FROM (SELECT *, lag(value) OVER w AS pv, lag(time) OVER w AS pt FROM v_counter
      WINDOW w AS (PARTITION BY metric_id, labels_key ORDER BY time)) o
WHERE pt IS NOT NULL"""


def _streamed_rates(spark: SparkSession, arrivals: list[DataFrame]) -> DataFrame:
    """Counters in several arrivals; the stream is restarted for each of them."""
    arrived, path = scratch_path(spark, "arrived"), scratch_path(spark, "stream-rate")
    state, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "checkpoint")
    for rows in arrivals:
        rows.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(rows.schema).parquet(arrived)
        stream_rate(stream, path, state, checkpoint, available_now=True).awaitTermination()
    return v.tidy(current_rates(spark, path))


@query("stream_rate", views=v.V_COUNTER, sql=_STREAM_RATE_SQL)
def stream_rate_query(spark, sf_dir):
    """The counters arrive ten days at a time."""
    rows = v.with_day(v.counter_samples(spark, sf_dir)).select(*KEY_VALUE, "day")
    spans = [F.col("day").between(F.lit(low), F.lit(high)) for low, high in _day_spans(rows, 10)]
    return _streamed_rates(spark, [rows.filter(span) for span in spans])


@query("stream_rate_shuffled", views=v.V_COUNTER, sql=_STREAM_RATE_SQL)
def stream_rate_shuffled(spark, sf_dir):
    """The counters arrive in no order, by the hash of their keys; late ones correct their successors."""
    rows = v.counter_samples(spark, sf_dir).select(*KEY_VALUE)
    share = F.pmod(F.xxhash64("time", "labels_key"), F.lit(3))
    return _streamed_rates(spark, [rows.filter(share == n) for n in range(3)])


def _day_spans(rows: DataFrame, days: int) -> list[tuple[date, date]]:
    """Consecutive spans that cover the days of the rows."""
    low, high = rows.agg(F.min("day"), F.max("day")).first()
    begins = range(0, (high - low).days + 1, days) if low else ()
    return [(low + timedelta(days=n), low + timedelta(days=n + days - 1)) for n in begins]


@query("stream_dedup", views=v.V_SAMPLES, sql="""
SELECT DISTINCT time, metric_id, labels_key FROM v_samples""")
def stream_dedup(spark, sf_dir):
    """Every event twice in the stream, once in the result."""
    rows = _event_stream(spark, sf_dir).select("time", "metric_id", "labels_key", "value")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    path = scratch_path(spark, "stream-dedup")
    writer = dedup_first_wins(twice, "1 hour").writeStream.format("parquet").option("path", path)
    start(writer, scratch_path(spark, "checkpoint"), True, "").awaitTermination()
    return v.tidy(spark.read.parquet(path).select("time", "metric_id", "labels_key"))
