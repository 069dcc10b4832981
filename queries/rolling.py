"""Rollup, catalogue, cardinality and validation queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from queries import views as v
from queries.registry import query
from seriesframe.config import CardinalityLimits, Settings
from seriesframe.functions import labels as label_functions
from seriesframe.functions.times import tier as tier_of
from seriesframe.operators import cardinality, catalog, filters, rollups, validation
from seriesframe.operators.filters import filter_metric
from seriesframe.plans.ingest import validate_batch

_ROLLUP_SQL = """
SELECT time_bucket(INTERVAL {width}, time) AS bucket, metric_id, labels_key,
       round(avg(value) + 1e-9, 6) AS avg_value, round(sum(value), 4) AS sum_value,
       min(value) AS min_value, max(value) AS max_value, count(*) AS sample_count
FROM {source} GROUP BY 1, 2, 3"""


@query("rollup_5m", views=v.V_SAMPLES, sql=_ROLLUP_SQL.format(width="5 MINUTES", source="v_samples"))
def rollup_5m(spark, sf_dir):
    return v.tidy(rollups.rollup(v.samples(spark, sf_dir), "5m"))


@query("rollup_1h", views=v.V_SAMPLES, sql=_ROLLUP_SQL.format(width="1 HOUR", source="v_samples"))
def rollup_1h(spark, sf_dir):
    return v.tidy(rollups.coarsen(rollups.rollup(v.samples(spark, sf_dir), "5m"), "1h"))


@query("rollup_1d", views=v.V_DENSE, sql=_ROLLUP_SQL.format(width="1 DAY", source="v_dense"))
def rollup_1d(spark, sf_dir):
    return v.tidy(rollups.rollup(v.dense_samples(spark, sf_dir), "1d"))


@query("rollup_read", views=v.V_SAMPLES, sql=_ROLLUP_SQL.format(
    width="1 HOUR", source="""(SELECT * FROM v_samples WHERE metric_id = 'click' AND shard = '7'
    AND time_bucket(INTERVAL 1 HOUR, time) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28') f"""))
def rollup_read(spark, sf_dir):
    made = rollups.rollup(v.samples(spark, sf_dir), "1h")
    found = rollups.read_rollup(made, "click", "2024-01-03", "2024-01-28", {"shard": "7"})
    return v.tidy(found.drop("labels"))


@query("rollup_requery", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, round(avg(value) + 1e-9, 6) AS avg_value,
       round(sum(value), 4) AS sum_value, min(value) AS min_value, max(value) AS max_value,
       CAST(count(*) AS BIGINT) AS sample_count
FROM v_samples WHERE metric_id = 'purchase' GROUP BY 1""")
def rollup_requery(spark, sf_dir):
    made = rollups.rollup(filter_metric(v.samples(spark, sf_dir), "purchase"), "5m")
    return v.tidy(rollups.merge_over_labels(made, 3_600))


@query("routed_query", views=v.V_SAMPLES, sql="""
SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, round(avg(value) + 1e-9, 6) AS value
FROM v_samples WHERE metric_id = 'view'
  AND time BETWEEN TIMESTAMP '2024-01-02 03:17:11' AND TIMESTAMP '2024-01-28 21:44:59'
GROUP BY 1""")
def routed_query(spark, sf_dir):
    found = v.with_day(filter_metric(v.samples(spark, sf_dir), "view"))
    buckets = rollups.routed_buckets(
        found, rollups.rollup(found, "1h"), "1h", 3_600, "2024-01-02 03:17:11", "2024-01-28 21:44:59"
    )
    return v.tidy(rollups.routed_agg(buckets, "AVG"))


# Catalogue


@query("list_metrics", views=v.V_METRICS, sql="""
SELECT id, name, type, description, '["band","shard"]' AS label_keys, retention_days, is_active
FROM v_metrics WHERE is_active ORDER BY name LIMIT 3 OFFSET 1""")
def list_metrics(spark, sf_dir):
    page = catalog.list_metrics(
        v.metrics(spark, sf_dir), v.metric_labels(spark, sf_dir), limit=3, offset=1
    )
    return _flat(page)


def _flat(metrics):
    return metrics.select(
        "id", "name", "type", "description", F.to_json("label_keys").alias("label_keys"),
        "retention_days", "is_active",
    )


@query("search_metrics", views=v.V_METRICS, sql="""
SELECT 'name' AS search, name, type, is_active FROM v_metrics WHERE name ILIKE '%R%'
UNION ALL SELECT 'type', name, type, is_active FROM v_metrics WHERE type = 'GAUGE'
UNION ALL SELECT 'both', name, type, is_active FROM v_metrics
  WHERE type = 'COUNTER' AND is_active AND name ILIKE '%i_%'
UNION ALL SELECT 'active', name, type, is_active FROM v_metrics WHERE is_active""")
def search_metrics(spark, sf_dir):
    metrics = v.metrics(spark, sf_dir)
    found = {
        "name": catalog.search_by_name(metrics, "R"),
        "type": catalog.filter_by_type(metrics, "gauge"),
        "both": catalog.search_by_type_and_name(metrics, "COUNTER", "i_"),
        "active": catalog.filter_active(metrics),
    }
    parts = [df.select(F.lit(k).alias("search"), "name", "type", "is_active") for k, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("metrics_with_labels", views=v.V_METRICS, sql="""
SELECT id, name, type, description, '["band","shard"]' AS label_keys, retention_days, is_active
FROM v_metrics""")
def metrics_with_labels(spark, sf_dir):
    return _flat(catalog.with_label_keys(v.metrics(spark, sf_dir), v.metric_labels(spark, sf_dir)))


@query("distinct_label_keys", sql="""
SELECT DISTINCT key AS label_key FROM (
  SELECT p_type, unnest(['brand', p_brand]) AS key FROM part) k
WHERE p_type = (SELECT min(p_type) FROM part)""")
def distinct_label_keys(spark, sf_dir):
    """Parts as label rows of metrics named by their type; the keys of the first type."""
    part = v.table(spark, sf_dir, "part")
    keys = F.explode(F.array(F.lit("brand"), F.col("p_brand"))).alias("label_key")
    rows = part.select(F.col("p_type").alias("metric_id"), keys)
    return catalog.distinct_label_keys(rows, part.agg(F.min("p_type")).first()[0])


@query("sample_metric_join", views=v.V_SAMPLES + "," + v.V_METRICS, sql="""
SELECT m.name, m.type, m.retention_days, count(*) AS samples, round(sum(s.value), 4) AS sum_value
FROM v_samples s JOIN v_metrics m ON s.metric_id = m.id GROUP BY 1, 2, 3""")
def sample_metric_join(spark, sf_dir):
    joined = catalog.join_metrics(v.samples(spark, sf_dir), v.metrics(spark, sf_dir))
    return v.tidy(joined.groupBy("name", "type", "retention_days").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("sum_value")
    ))


@query("metric_update", views=v.V_METRICS, sql="""
SELECT id, CASE WHEN id = 'click' THEN 90 ELSE retention_days END AS retention_days,
       CASE WHEN id = 'view' THEN false ELSE is_active END AS is_active,
       CASE WHEN id IN ('click', 'view') THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM v_metrics""")
def metric_update(spark, sf_dir):
    changed = catalog.update_metric(v.metrics(spark, sf_dir), "click", v.AS_OF, retention_days=90)
    changed = catalog.deactivate_metric(changed, "view", v.AS_OF)
    return v.tidy(changed.select("id", "retention_days", "is_active", "updated_at"))


# Cardinality


@query("cardinality", views=v.V_SAMPLES, sql="""
SELECT metric_id, count(DISTINCT labels_key) AS series FROM v_samples
WHERE time > TIMESTAMP '2024-01-01' GROUP BY 1""")
def cardinality_query(spark, sf_dir):
    return cardinality.cardinality(v.samples(spark, sf_dir), v.AS_OF, hours=30 * 24)


@query("cardinality_stats", views=v.V_SAMPLES, sql="""
SELECT metric_id, n AS current_cardinality, 20 AS max_allowed,
       round(n * 100.0 / 20 + 1e-9, 6) AS utilization_percent, n > 16 AS is_warning, n >= 20 AS is_critical
FROM (SELECT metric_id, count(DISTINCT labels_key) AS n FROM v_samples
      WHERE time > TIMESTAMP '2024-01-30' GROUP BY 1) c""")
def cardinality_stats(spark, sf_dir):
    limits = CardinalityLimits(max_series_per_metric=20)
    return v.tidy(cardinality.cardinality_stats(v.samples(spark, sf_dir), v.AS_OF, limits))


@query("label_cardinality", views=v.V_SAMPLES, sql="""
SELECT metric_id, 'band' AS label_key, count(DISTINCT band) AS distinct_values FROM v_samples GROUP BY 1
UNION ALL
SELECT metric_id, 'shard', count(DISTINCT shard) FROM v_samples GROUP BY 1""")
def label_cardinality(spark, sf_dir):
    return cardinality.label_cardinality(v.samples(spark, sf_dir))


@query("series_limit", views=v.V_SAMPLES, sql="""
, known AS (SELECT DISTINCT metric_id, labels_key FROM v_samples
            WHERE time > TIMESTAMP '2024-01-05' - INTERVAL 24 HOUR AND time <= TIMESTAMP '2024-01-05'),
counts AS (SELECT metric_id, count(*) AS n FROM known GROUP BY 1)
SELECT s.metric_id, s.labels_key, coalesce(c.n, 0) AS series,
       coalesce(c.n, 0) >= 15 AND k.labels_key IS NULL AS over_limit, count(*) AS samples
FROM v_samples s LEFT JOIN counts c ON s.metric_id = c.metric_id
LEFT JOIN known k ON s.metric_id = k.metric_id AND s.labels_key = k.labels_key
GROUP BY 1, 2, 3, 4""")
def series_limit(spark, sf_dir):
    found = v.samples(spark, sf_dir)
    stored = found.filter(F.col("time") <= F.lit(datetime(2024, 1, 5)).cast("timestamp"))
    limits = CardinalityLimits(max_series_per_metric=15)
    marked = cardinality.mark_series_limit(found, stored, "2024-01-05", limits)
    return marked.groupBy("metric_id", "labels_key", "series", "over_limit").agg(
        F.count(F.lit(1)).alias("samples")
    )


@query("series_limit_rejects", views=v.V_SAMPLES, sql="""
, known AS (SELECT DISTINCT metric_id, labels_key FROM v_samples
            WHERE time > TIMESTAMP '2024-01-04' AND time < TIMESTAMP '2024-01-05'),
n AS (SELECT metric_id, count(*) AS n FROM known GROUP BY 1)
SELECT mode, coalesce(CASE WHEN mode = 'strict_all' AND coalesce(n.n, 0) >= 15 THEN 'series_over_limit'
                           WHEN mode = 'unseen' AND coalesce(n.n, 0) >= 15 AND k.labels_key IS NULL THEN 'series_over_limit'
                      END, 'accepted') AS outcome, count(*) AS samples
FROM v_samples s CROSS JOIN (SELECT unnest(['unseen', 'strict_all']) AS mode) m
LEFT JOIN n ON n.metric_id = s.metric_id
LEFT JOIN known k ON k.metric_id = s.metric_id AND k.labels_key = s.labels_key
WHERE s.time >= TIMESTAMP '2024-01-05' AND s.time < TIMESTAMP '2024-01-06' GROUP BY 1, 2""")
def series_limit_rejects(spark, sf_dir):
    """One day of samples against the series of the day before, under both rules for full metrics."""
    found = v.samples(spark, sf_dir)
    stored = found.filter("time < '2024-01-05'")
    day = found.filter("time >= '2024-01-05' AND time < '2024-01-06'").select(
        F.col("arrival").alias("idx"), F.col("metric_id").alias("name"), "value",
        F.col("time").alias("timestamp"), "labels", F.lit(None).cast("string").alias("type"),
    )
    registry = v.metrics(spark, sf_dir).withColumn("label_keys", F.array(F.lit("band"), F.lit("shard")))
    counted = []
    for mode in ("unseen", "strict_all"):
        limits = CardinalityLimits(max_series_per_metric=15, at_limit=mode, check_window_hours=48)
        checked = validate_batch(
            day, registry, "2024-01-06", Settings(cardinality=limits), stored
        ).validated
        counted.append(checked.groupBy(
            F.lit(mode).alias("mode"), F.coalesce("reason", F.lit("accepted")).alias("outcome")
        ).agg(F.count(F.lit(1)).alias("samples")))
    return counted[0].union(counted[1])


@query("series_quota", views=v.V_SAMPLES, sql="""
, known AS (SELECT DISTINCT metric_id, labels_key FROM v_samples
            WHERE time >= TIMESTAMP '2024-01-04' AND time < TIMESTAMP '2024-01-05' AND CAST(shard AS INTEGER) < 5),
n AS (SELECT metric_id, count(*) AS n FROM known GROUP BY 1),
fresh AS (SELECT metric_id, labels_key, min(arrival) AS first FROM v_samples ANTI JOIN known USING (metric_id, labels_key)
          WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-06' AND shard <> '9' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY first, labels_key) AS rank,
                  count(*) OVER (PARTITION BY metric_id) AS wanted FROM fresh),
sized AS (SELECT limit_, m.metric_id, coalesce(n.n, 0) AS n, coalesce(max(r.wanted), 0) AS wanted
          FROM (SELECT unnest([12, 14, 40]) AS limit_) l, (SELECT DISTINCT metric_id FROM v_samples) m
          LEFT JOIN n USING (metric_id) LEFT JOIN ranked r USING (metric_id) GROUP BY 1, 2, 3),
after AS (SELECT *, n + least(wanted, greatest(limit_ - n, 0)) AS series FROM sized)
SELECT a.limit_ AS max_series, s.metric_id, s.labels_key, a.series,
       CASE WHEN s.shard = '9' THEN 'missing_labels' WHEN r.rank > greatest(a.limit_ - a.n, 0) THEN 'series_over_limit'
            ELSE 'accepted' END AS outcome,
       a.series > a.limit_ * 0.8 AND a.series < a.limit_ AS near_limit, count(*) AS samples
FROM v_samples s JOIN after a USING (metric_id) LEFT JOIN ranked r USING (metric_id, labels_key)
WHERE s.time >= TIMESTAMP '2024-01-05' AND s.time < TIMESTAMP '2024-01-06' GROUP BY ALL""")
def series_quota(spark, sf_dir):
    """A day with more new series than fit: the first to arrive get the places, for three limits.

    Rejected samples take none: those of the last shard lack a label.
    """
    found = v.samples(spark, sf_dir)
    stored = found.filter("time >= '2024-01-04' AND time < '2024-01-05' AND CAST(labels.shard AS INT) < 5")
    labels = F.when(F.col("labels")["shard"] == "9", F.map_filter("labels", lambda k, _: k != "shard")).otherwise(F.col("labels"))
    day = found.filter("time >= '2024-01-05' AND time < '2024-01-06'").select(
        F.col("arrival").alias("idx"), F.col("metric_id").alias("name"), "value", F.col("time").alias("timestamp"),
        labels.alias("labels"), F.lit(None).cast("string").alias("type"), F.col("labels_key").alias("series_key"),
    )
    registry = v.metrics(spark, sf_dir).withColumn("label_keys", F.array(F.lit("band"), F.lit("shard")))
    made = None
    for most in (12, 14, 40):
        limits = CardinalityLimits(max_series_per_metric=most, at_limit="quota", check_window_hours=48)
        checked = validate_batch(day, registry, "2024-01-06", Settings(cardinality=limits), stored).validated
        rows = checked.groupBy(
            F.lit(most).alias("max_series"), "metric_id", F.col("series_key").alias("labels_key"), "series",
            F.coalesce("reason", F.lit("accepted")).alias("outcome"),
            F.array_contains("warnings", "series_near_limit").alias("near_limit"),
        ).agg(F.count(F.lit(1)).alias("samples"))
        made = rows if made is None else made.unionByName(rows)
    return made


@query("too_many_labels", views=v.V_SAMPLES, sql="""
SELECT CASE WHEN arrival % 14 > 10 THEN 'label_count_over_limit' ELSE 'accepted' END AS outcome, count(*) AS samples
FROM v_samples GROUP BY 1""")
def too_many_labels(spark, sf_dir):
    """Samples with none to thirteen labels; the limit is ten."""
    keys = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda n: F.concat(F.lit("key"), n.cast("string")))
    count = (F.col("arrival") % 14).cast("int")
    rows = v.samples(spark, sf_dir).withColumn("label_keys", F.slice(keys, 1, count))
    rows = rows.withColumn("labels", F.map_from_arrays("label_keys", "label_keys"))
    reason = F.coalesce(validation.cardinality_problem(Settings()), F.lit("accepted"))
    return rows.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("samples"))


@query("default_range", views=v.V_SAMPLES, sql="""
SELECT 'none' AS given, count(*) AS samples FROM v_samples WHERE time BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30'
UNION ALL SELECT 'end', count(*) FROM v_samples WHERE time BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-10'
UNION ALL SELECT 'start', count(*) FROM v_samples WHERE time BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-30'
UNION ALL SELECT 'too long', 0""")
def default_range(spark, sf_dir):
    """Missing ends of a range, and a range that is refused."""
    as_of, parts = "2024-01-30", []
    for name, start, end in (("none", None, None), ("end", None, "2024-01-10"), ("start", "2024-01-12", None)):
        first, last = filters.default_range(start, end, as_of)
        filters.check_range(first, last, 90)
        parts.append(filters.filter_time(v.samples(spark, sf_dir), first, last).withColumn("given", F.lit(name)))
    try:
        filters.check_range(*filters.default_range("2023-10-01", "2024-01-30", as_of), 90)
    except ValueError:
        parts.append(v.samples(spark, sf_dir).filter("false").withColumn("given", F.lit("too long")))
    counted = [
        part.agg(F.count(F.lit(1)).alias("samples")).select(F.lit(name).alias("given"), "samples")
        for part, name in zip(parts, ("none", "end", "start", "too long"))
    ]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


# Validation and registration


def _validated(spark, sf_dir, settings=Settings()):
    return validate_batch(
        v.dirty_samples(spark, sf_dir), v.known_registry(spark, sf_dir), v.AS_OF, settings
    )


@query("validate_rejects", views=v.V_DIRTY, sql="""
SELECT idx, name, reason FROM v_validated WHERE reason IS NOT NULL""")
def validate_rejects(spark, sf_dir):
    return _validated(spark, sf_dir).rejected


@query("validate_summary", views=v.V_DIRTY, sql="""
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason,
       count(*) AS samples FROM v_validated GROUP BY 1, 2""")
def validate_summary(spark, sf_dir):
    return _validated(spark, sf_dir).summary


@query("label_warnings", views=v.V_DIRTY, sql="""
SELECT idx, 'high_cardinality_label:user_id' AS warnings FROM v_dirty WHERE kind = 21""")
def label_warnings(spark, sf_dir):
    found = v.dirty_samples(spark, sf_dir).select(
        "idx", F.array_join(validation.cardinality_warnings(), "; ").alias("warnings")
    )
    return found.filter("warnings <> ''")


@query("high_cardinality_keys", views=v.V_DIRTY, sql=f"""
SELECT DISTINCT k AS label_key,
       regexp_matches(lower(k), '{"|".join(label_functions.HIGH_CARDINALITY_WORDS)}') AS suspicious
FROM v_pairs""")
def high_cardinality_keys(spark, sf_dir):
    keys = v.dirty_samples(spark, sf_dir).select(F.explode(F.map_keys("labels")).alias("label_key"))
    return keys.distinct().select(
        "label_key", label_functions.is_high_cardinality("label_key").alias("suspicious")
    )


def _registered(spark, sf_dir):
    registry = v.known_registry(spark, sf_dir)
    return validation.attach_registry(v.dirty_samples(spark, sf_dir), registry).filter(
        "label_keys IS NOT NULL"
    )


@query("missing_labels", views=v.V_DIRTY, sql="""
SELECT idx, array_to_string(list_sort(list_filter(['band', 'shard'], lambda x: NOT list_contains(ks, x))), ',') AS missing
FROM v_dirty WHERE name IN ('click', 'signup', 'view', 'purchase')
  AND len(list_filter(['band', 'shard'], lambda x: NOT list_contains(ks, x))) > 0""")
def missing_labels(spark, sf_dir):
    missing = F.array_join(validation.missing_labels("labels", "label_keys"), ",")
    return _registered(spark, sf_dir).select("idx", missing.alias("missing")).filter("missing <> ''")


@query("extra_labels", views=v.V_DIRTY, sql="""
SELECT idx, array_to_string(list_sort(list_filter(ks, lambda x: NOT list_contains(['band', 'shard'], x))), ',') AS extra
FROM v_dirty WHERE name IN ('click', 'signup', 'view', 'purchase')
  AND len(list_filter(ks, lambda x: NOT list_contains(['band', 'shard'], x) AND x <> '')) > 0""")
def extra_labels(spark, sf_dir):
    extra = F.array_join(validation.extra_labels("labels", "label_keys"), ",")
    return _registered(spark, sf_dir).select("idx", extra.alias("extra")).filter("extra <> ''")


@query("register_metrics", views=v.V_REGISTRATIONS, sql="""
SELECT idx, name, coalesce(reason, 'registered') AS outcome FROM v_registered""")
def register_metrics(spark, sf_dir):
    checked = catalog.check_registrations(v.registrations(spark, sf_dir), v.metrics(spark, sf_dir))
    return checked.select("idx", "name", F.coalesce("reason", F.lit("registered")).alias("outcome"))


@query("registered_dimension", views=v.V_REGISTRATIONS, sql="""
, ids AS (SELECT *, md5(name) AS h FROM v_registered WHERE reason IS NULL)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
       || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, name, type, retention_days, true AS is_active
FROM ids""")
def registered_dimension(spark, sf_dir):
    checked = catalog.check_registrations(v.registrations(spark, sf_dir), v.metrics(spark, sf_dir))
    rows = catalog.new_metric_rows(checked.filter("reason IS NULL"), v.AS_OF)
    return rows.select("id", "name", "type", "retention_days", "is_active")


@query("auto_register", views=v.V_DIRTY, sql="""
SELECT name, arg_min(coalesce(type, 'GAUGE'), idx) AS type, 'Auto-registered metric' AS description
FROM v_sample_problem WHERE sample_problem IS NULL AND name = 'error' GROUP BY name""")
def auto_register(spark, sf_dir):
    return _validated(spark, sf_dir).registrations.select("name", "type", "description")


@query("auto_register_adopt", views=v.V_DIRTY_ADOPT, sql="""
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS samples FROM v_validated GROUP BY 1""")
def auto_register_adopt(spark, sf_dir):
    """An unknown name takes over the labels of its first sample instead of rejecting them."""
    done = _validated(spark, sf_dir, Settings(auto_register_labels="adopt")).validated
    return done.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("samples")
    )


@query("tiers", views=v.V_SAMPLES, sql="""
SELECT metric_id, CASE WHEN time > TIMESTAMP '2024-01-31' - INTERVAL 10 DAY THEN 'hot'
                       WHEN time > TIMESTAMP '2024-01-31' - INTERVAL 25 DAY THEN 'warm'
                       ELSE 'cold' END AS tier, count(*) AS samples
FROM v_samples GROUP BY 1, 2""")
def tiers(spark, sf_dir):
    found = v.samples(spark, sf_dir).withColumn("tier", tier_of("time", v.AS_OF, 10, 25))
    return found.groupBy("metric_id", "tier").agg(F.count(F.lit(1)).alias("samples"))
