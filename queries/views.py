"""The driver's tables seen as metrics and samples, in Spark and as SQL common table expressions.

``events`` gives five metrics with two labels (20 label sets each); ``lineitem`` gives one dense
metric with many samples per key; ``part`` gives registration requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.functions.labels import canonical_key
from seriesframe.session import configure

START = "2024-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"
COUNTERS = ("click", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def band_and_shard(user_id: Column, props: Column) -> Column:
    k = F.get_json_object(props, "$.k").cast("int")
    return F.create_map(
        F.lit("band"), F.when(k < 50, "low").otherwise("high"),
        F.lit("shard"), (user_id % 10).cast("string"),
    )


def event_samples(events: DataFrame) -> DataFrame:
    """Samples of an events frame, batch or streaming."""
    labels = band_and_shard(F.col("user_id"), F.col("props"))
    return events.select(
        F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("metric_id"),
        "value", F.col("event_id").alias("arrival"), labels.alias("labels"),
    ).select("*", canonical_key("labels").alias("labels_key"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(table(spark, sf_dir, "events"))


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("time"))


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers growing with time at a pace per shard, reset every six hours."""
    seconds = F.floor(F.unix_micros("time") / 1_000_000) % 21_600
    pace = F.col("labels")["shard"].cast("int") + 1
    found = samples(spark, sf_dir).filter(F.col("metric_id").isin(*COUNTERS))
    return found.withColumn("value", (seconds * pace).cast("double"))


def two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample, then a correcting batch that raises the high band by one."""
    first = samples(spark, sf_dir).withColumn("batch_id", F.lit(1).cast("long"))
    second = first.filter(F.col("labels")["band"] == "high").withColumn(
        "value", F.col("value") + 1
    ).withColumn("batch_id", F.lit(2).cast("long"))
    return first.unionByName(second)


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one metric; many rows share a key, so upserts conflict heavily."""
    labels = F.create_map(
        F.lit("linestatus"), F.col("l_linestatus"), F.lit("returnflag"), F.col("l_returnflag")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.lit("extendedprice").alias("metric_id"), F.col("l_extendedprice").alias("value"),
        labels.alias("labels"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    ).withColumn("labels_key", canonical_key("labels"))


DENSE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value"]


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric dimension: one metric per event type; ``error`` is inactive."""
    created = F.lit(START).cast("timestamp")
    name = F.col("event_type")
    is_counter = name.isin(*COUNTERS)
    return table(spark, sf_dir, "events").select("event_type").distinct().select(
        name.alias("id"), name.alias("name"),
        F.when(is_counter, "COUNTER").otherwise("GAUGE").alias("type"),
        F.concat(F.lit("events of type "), name).alias("description"),
        F.lit(None).cast("string").alias("unit"),
        F.when(is_counter, 10).otherwise(20).alias("retention_days"),
        (name != "error").alias("is_active"),
        created.alias("created_at"), created.alias("updated_at"),
    )


def metric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.array(F.lit("shard"), F.lit("band"))).alias("label_key")
    return metrics(spark, sf_dir).select(F.col("id").alias("metric_id"), keys)


def dirty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an incoming sample; some break one ingest rule, chosen by event id."""
    kind = F.col("event_id") % 40
    event = F.col("event_type")
    base = band_and_shard(F.col("user_id"), F.col("props"))
    band, shard = base["band"], base["shard"]

    def labels(*pairs) -> Column:
        return F.create_map(*[p if isinstance(p, Column) else F.lit(p) for p in pairs])

    name = (
        F.when(kind == 0, "").when(kind == 1, "   ").when(kind == 2, F.repeat(F.lit("a"), 256))
        .when(kind == 3, F.concat(F.lit("9"), event)).when(kind == 4, F.concat(event, F.lit(" x")))
        .when(kind == 5, F.concat(event, F.lit("@m"))).when(kind == 6, F.concat(event, F.lit("\n")))
        .otherwise(event)
    )
    value = (
        F.when(kind == 7, float("nan")).when(kind == 8, float("inf"))
        .when(kind == 9, float("-inf")).otherwise(F.col("value"))
    )
    time = (
        F.when(kind == 10, F.col("ts") + F.expr("INTERVAL 31 DAYS"))
        .when(kind == 11, F.col("ts") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("ts"))
    )
    label_map = (
        F.when(kind == 12, labels("band", band, "", shard))
        .when(kind == 13, labels("band", band, F.repeat(F.lit("k"), 101), shard))
        .when(kind == 14, labels("band", band, "bad-key", shard))
        .when(kind == 15, labels("band", "", "shard", shard))
        .when(kind == 16, labels("band", F.repeat(F.lit("v"), 501), "shard", shard))
        .when(kind == 17, labels("shard", shard))
        .when(kind == 18, labels("band", band, "shard", shard, "unregistered_label", "x"))
        .when(kind == 19, labels("band", F.repeat(F.lit("v"), 101), "shard", shard))
        .when(kind == 20, labels("shard", shard, "band", band))
        .when(kind == 21, labels("zone", band, "user_id", shard))
        .otherwise(labels("band", band, "shard", shard))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), name.alias("name"), value.alias("value"),
        time.cast("timestamp").alias("timestamp"), label_map.alias("labels"),
        F.when(kind < 30, F.lit(None).cast("string")).otherwise("COUNTER").alias("type"),
    )


def known_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event types but ``error`` are registered, with the labels band and shard."""
    keys = F.array(F.lit("band"), F.lit("shard"))
    found = metrics(spark, sf_dir).filter(F.col("name") != "error")
    return found.withColumn("label_keys", keys)


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a registration request; many repeat a name or break a rule."""
    size = F.col("p_size")
    plain = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.lower("p_type"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"),
        F.when(size > 45, F.col("p_name")).when(size == 44, "click").otherwise(plain).alias("name"),
        F.when(size == 43, "TIMER").when(size % 2 == 0, "COUNTER").otherwise("GAUGE").alias("type"),
        F.col("p_type").alias("description"), F.lit("unit").alias("unit"),
        F.when(size == 1, F.array(F.lit("brand"), F.col("p_brand")))
        .otherwise(F.array(F.lit("brand"), F.lit("type"))).alias("labels"),
        F.when(size == 2, 0).when(size > 40, size * 50).otherwise(size).cast("int")
        .alias("retention_days"),
    )


def tidy(df: DataFrame, sums: tuple[str, ...] = ("sum_value", "sum")) -> DataFrame:
    """Comparable form: zone-free timestamps, rounded doubles."""
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
        elif kind == "double":
            # The nudge keeps exact ties from rounding apart in two engines.
            df = df.withColumn(
                name, F.round(name, 4) if name in sums else F.round(F.col(name) + 1e-9, 6)
            )
    return df


# The same views as SQL.

V_SAMPLES = """
v_samples AS (
  SELECT ts AS time, event_type AS metric_id, value, event_id AS arrival, band, shard,
         '{"band":"' || band || '","shard":"' || shard || '"}' AS labels_key,
         CAST(ts AS DATE) AS day
  FROM (
    SELECT *, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50
                   THEN 'low' ELSE 'high' END AS band,
           CAST(user_id % 10 AS VARCHAR) AS shard
    FROM events) e)
"""

V_COUNTER = V_SAMPLES + """,
v_counter AS (
  SELECT time, metric_id, labels_key, band, shard,
         CAST(((epoch_us(time) // 1000000) % 21600) * (CAST(shard AS INTEGER) + 1) AS DOUBLE) AS value
  FROM v_samples WHERE metric_id IN ('click', 'signup', 'view'))
"""

V_UPSERT = V_SAMPLES + """,
v_upsert AS (
  SELECT time, metric_id, labels_key, value, 1 AS batch_id FROM v_samples
  UNION ALL
  SELECT time, metric_id, labels_key, value + 1, 2 FROM v_samples WHERE band = 'high')
"""

V_DENSE = """
v_dense AS (
  SELECT l_shipdate AS time, 'extendedprice' AS metric_id, l_extendedprice AS value,
         '{"linestatus":"' || l_linestatus || '","returnflag":"' || l_returnflag || '"}' AS labels_key,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
  FROM lineitem)
"""

V_METRICS = """
v_metrics AS (
  SELECT event_type AS id, event_type AS name,
         CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'COUNTER' ELSE 'GAUGE' END AS type,
         'events of type ' || event_type AS description,
         CASE WHEN event_type IN ('click', 'signup', 'view') THEN 10 ELSE 20 END AS retention_days,
         event_type <> 'error' AS is_active
  FROM (SELECT DISTINCT event_type FROM events) t)
"""

_DIRTY = """
v_dirty AS (
  SELECT event_id AS idx, event_id % 40 AS kind, event_type,
    CASE event_id % 40
      WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN repeat('a', 256)
      WHEN 3 THEN '9' || event_type WHEN 4 THEN event_type || ' x'
      WHEN 5 THEN event_type || '@m' WHEN 6 THEN event_type || chr(10)
      ELSE event_type END AS name,
    CASE event_id % 40
      WHEN 7 THEN CAST('NaN' AS DOUBLE) WHEN 8 THEN CAST('Infinity' AS DOUBLE)
      WHEN 9 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value,
    CASE event_id % 40
      WHEN 10 THEN ts + INTERVAL 31 DAY WHEN 11 THEN ts - INTERVAL 400 DAY ELSE ts END AS time,
    CASE event_id % 40
      WHEN 12 THEN ['band', ''] WHEN 13 THEN ['band', repeat('k', 101)]
      WHEN 14 THEN ['band', 'bad-key'] WHEN 17 THEN ['shard']
      WHEN 18 THEN ['band', 'shard', 'unregistered_label'] WHEN 20 THEN ['shard', 'band']
      WHEN 21 THEN ['zone', 'user_id'] ELSE ['band', 'shard'] END AS ks,
    CASE event_id % 40
      WHEN 15 THEN ['', shard] WHEN 16 THEN [repeat('v', 501), shard]
      WHEN 17 THEN [shard] WHEN 18 THEN [band, shard, 'x']
      WHEN 19 THEN [repeat('v', 101), shard] WHEN 20 THEN [shard, band]
      ELSE [band, shard] END AS vs,
    CASE WHEN event_id % 40 < 30 THEN NULL ELSE 'COUNTER' END AS type
  FROM (
    SELECT *, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50
                   THEN 'low' ELSE 'high' END AS band,
           CAST(user_id % 10 AS VARCHAR) AS shard
    FROM events) e),
v_pairs AS (
  SELECT idx, unnest(ks) AS k, unnest(vs) AS v, generate_subscripts(ks, 1) AS pos FROM v_dirty),
v_label_problem AS (
  SELECT idx, arg_min(problem, pos) AS problem
  FROM (
    SELECT idx, pos, CASE
      WHEN regexp_full_match(k, '\\s*') THEN 'label_key_blank'
      WHEN length(k) > 100 THEN 'label_key_too_long'
      WHEN NOT regexp_full_match(k, '[a-zA-Z][a-zA-Z0-9_]*') THEN 'label_key_invalid'
      WHEN regexp_full_match(v, '\\s*') THEN 'label_value_blank'
      WHEN length(v) > 500 THEN 'label_value_too_long' END AS problem
    FROM v_pairs) p
  WHERE problem IS NOT NULL GROUP BY idx),
v_long_values AS (
  SELECT idx, string_agg('label_value_over_limit:' || k, '; ' ORDER BY pos) AS problem
  FROM v_pairs WHERE length(v) > 100 GROUP BY idx),
v_sample_problem AS (
  SELECT *, CASE
    WHEN regexp_full_match(name, '\\s*') THEN 'name_blank'
    WHEN length(name) > 255 THEN 'name_too_long'
    WHEN NOT regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_.-]*') THEN 'name_invalid'
    WHEN isnan(value) OR isinf(value) THEN 'value_not_finite'
    WHEN time > TIMESTAMP '2024-01-31 00:05:00' THEN 'timestamp_in_future'
    WHEN time < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 365 DAY THEN 'timestamp_too_old'
  END AS sample_problem FROM v_dirty),
v_keyed AS (
  SELECT *, CASE WHEN event_type = 'error' THEN %s ELSE ['band', 'shard'] END AS label_keys
  FROM v_sample_problem),
v_validated AS (
  SELECT d.*, coalesce(sample_problem, l.problem,
      CASE WHEN len(list_filter(label_keys, lambda x: NOT list_contains(ks, x))) > 0
           THEN 'missing_labels' END,
      CASE WHEN len(list_filter(ks, lambda x: NOT list_contains(label_keys, x))) > 0
           THEN 'extra_labels' END,
      g.problem) AS reason
  FROM v_keyed d
  LEFT JOIN v_label_problem l ON d.idx = l.idx
  LEFT JOIN v_long_values g ON d.idx = g.idx)
"""

# ``error`` is not registered: it gets no labels, or those of its first valid sample.
V_DIRTY = _DIRTY.replace("%s", "CAST([] AS VARCHAR[])")
V_DIRTY_ADOPT = _DIRTY.replace("%s", """(
    SELECT arg_min(ks, idx) FROM v_sample_problem WHERE sample_problem IS NULL AND name = 'error')""")

V_REGISTRATIONS = """
v_requests AS (
  SELECT p_partkey AS idx,
    CASE WHEN p_size > 45 THEN p_name WHEN p_size = 44 THEN 'click'
         ELSE replace(p_name, ' ', '_') || '.' || lower(p_type) END AS name,
    CASE WHEN p_size = 43 THEN 'TIMER' WHEN p_size % 2 = 0 THEN 'COUNTER' ELSE 'GAUGE' END AS type,
    CASE WHEN p_size = 1 THEN ['brand', p_brand] ELSE ['brand', 'type'] END AS labels,
    CASE WHEN p_size = 2 THEN 0 WHEN p_size > 40 THEN p_size * 50 ELSE p_size END AS retention_days
  FROM part),
v_ruled AS (
  SELECT *, CASE
    WHEN NOT regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_.-]*') THEN 'name_invalid'
    WHEN type NOT IN ('COUNTER', 'GAUGE', 'HISTOGRAM', 'SUMMARY') THEN 'type_invalid'
    WHEN len(list_filter(labels, lambda x: NOT regexp_full_match(x, '[a-zA-Z][a-zA-Z0-9_]*'))) > 0
      THEN 'label_key_invalid'
    WHEN retention_days < 1 THEN 'retention_too_short'
    WHEN retention_days > 1825 THEN 'retention_too_long' END AS rule
  FROM v_requests),
v_registered AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN rule
    WHEN name IN (SELECT DISTINCT event_type FROM events) THEN 'duplicate'
    WHEN idx > min(CASE WHEN rule IS NULL THEN idx END) OVER (PARTITION BY name) THEN 'duplicate'
    END AS reason
  FROM v_ruled)
"""
