"""The metric dimension: look-ups, searches, registration rules and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.config import Settings
from seriesframe.functions.times import ts_lit
from seriesframe.schema import METRIC_TYPES
from seriesframe.operators.validation import (
    LABEL_KEY_PATTERN, first_problem, is_blank, longer_than, name_problem,
)

# Fixed value: description of a metric nobody registered.
AUTO_DESCRIPTION = "Auto-registered metric"


class MetricNotFound(LookupError):
    pass


def metric_uuid(name: Column | str) -> Column:
    """Name-based id: the same on every recomputation, unlike a random one."""
    digest = F.md5(F.col(name) if isinstance(name, str) else name)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def resolve_metric(metrics: DataFrame, name: str):
    """The one row of a metric; an unknown name raises."""
    if not name or not name.strip():
        raise ValueError("the metric name is blank")
    row = metrics.filter(F.col("name") == name).first()
    if row is None:
        raise MetricNotFound(name)
    return row


def metric_by_id(metrics: DataFrame, metric_id: str):
    """The one row with this id; an unknown id raises."""
    row = metrics.filter(F.col("id") == metric_id).first()
    if row is None:
        raise MetricNotFound(metric_id)
    return row


def distinct_label_keys(metric_labels: DataFrame, metric_id: str) -> DataFrame:
    """Label keys registered for one metric."""
    return metric_labels.filter(F.col("metric_id") == metric_id).select("label_key").distinct()


def filter_active(metrics: DataFrame) -> DataFrame:
    return metrics.filter("is_active")


def filter_by_type(metrics: DataFrame, metric_type: str) -> DataFrame:
    return metrics.filter(F.col("type") == metric_type.upper())


def search_by_name(metrics: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring; % and _ in the text act as wildcards."""
    return metrics.filter(F.lower("name").like(f"%{text.lower()}%"))


def search_by_type_and_name(metrics: DataFrame, metric_type: str, text: str) -> DataFrame:
    return filter_active(search_by_name(filter_by_type(metrics, metric_type), text))


def label_keys(metric_labels: DataFrame) -> DataFrame:
    """Sorted distinct label keys per metric; registration allows ten at most."""
    return metric_labels.groupBy("metric_id").agg(
        F.sort_array(F.collect_set("label_key")).alias("label_keys")
    )


def with_label_keys(metrics: DataFrame, metric_labels: DataFrame) -> DataFrame:
    keys = label_keys(metric_labels).withColumnRenamed("metric_id", "id")
    return metrics.join(keys, "id", "left").withColumn(
        "label_keys", F.coalesce("label_keys", F.array().cast("array<string>"))
    )


def join_metrics(samples: DataFrame, metrics: DataFrame) -> DataFrame:
    """Samples with their metric. No hint: Spark broadcasts the dimension from its measured
    size, and beyond that joins by shuffle with skewed metrics split by AQE."""
    return samples.join(metrics.withColumnRenamed("id", "metric_id"), "metric_id")


def list_metrics(
    metrics: DataFrame,
    metric_labels: DataFrame,
    metric_type: str | None = None,
    search: str | None = None,
    limit: int = 20,
    offset: int = 0,
    include_inactive: bool = False,
) -> DataFrame:
    """One catalogue page, ordered by name."""
    found = metrics if include_inactive else filter_active(metrics)
    if metric_type:
        found = filter_by_type(found, metric_type)
    if search and search.strip():
        found = search_by_name(found, search)
    page = found.orderBy("name").offset(offset).limit(limit)
    return with_label_keys(page, metric_labels).orderBy("name")


def registration_problem(settings: Settings = Settings()) -> Column:
    """First rule a registration breaks, or NULL."""
    keys = F.coalesce("labels", F.array().cast("array<string>"))
    longest = settings.ingest.max_label_key_length
    label_problems = F.transform(keys, lambda key: F.coalesce(
        F.when(is_blank(key), "label_key_blank"),
        F.when(longer_than(key, longest), "label_key_too_long"),
        F.when(~key.rlike(LABEL_KEY_PATTERN), "label_key_invalid"),
    ))
    days = F.coalesce("retention_days", F.lit(settings.default_retention_days))
    return first_problem(
        name_problem("name", settings.ingest),
        F.when(F.col("type").isNull() | ~F.col("type").isin(*METRIC_TYPES), "type_invalid"),
        F.when(F.size(keys) > settings.cardinality.max_labels_per_metric, "too_many_labels"),
        F.get(F.array_compact(label_problems), 0),
        F.when(days < 1, "retention_too_short"),
        F.when(days > settings.max_retention_days, "retention_too_long"),
        F.when(longer_than("description", 1000), "description_too_long"),
        F.when(longer_than("unit", 100), "unit_too_long"),
    )


def check_registrations(
    requests: DataFrame, metrics: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Adds ``reason``: a broken rule, ``duplicate`` for a taken name, or NULL.

    Of several requests for one new name the first by ``idx`` wins.
    """
    ruled = requests.withColumn("reason", registration_problem(settings))
    taken = metrics.select("name").withColumn("taken", F.lit(True))
    valid = F.when(F.col("reason").isNull(), F.col("idx"))
    firsts = ruled.groupBy("name").agg(F.min(valid).alias("first_idx"))
    late = F.col("idx") > F.col("first_idx")
    return (
        ruled.join(taken, "name", "left").join(firsts, "name", "left")
        .withColumn("reason", F.coalesce(
            "reason", F.when(F.col("taken") | late, F.lit("duplicate"))
        ))
        .drop("taken", "first_idx")
    )


def new_metric_rows(accepted: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """Dimension rows for accepted registrations."""
    now = ts_lit(as_of)
    return accepted.select(
        metric_uuid("name").alias("id"), "name", "type", "description", "unit",
        F.coalesce("retention_days", F.lit(settings.default_retention_days)).alias("retention_days"),
        F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at"),
    )


def new_label_rows(accepted: DataFrame) -> DataFrame:
    keys = F.explode(F.array_distinct("labels")).alias("label_key")
    return accepted.select(metric_uuid("name").alias("metric_id"), keys)


def auto_registrations(
    valid_samples: DataFrame, metrics: DataFrame, adopt_labels: bool = False
) -> DataFrame:
    """Registrations for unknown names: type of the first sample by ``idx``, else GAUGE.

    Labels stay empty unless ``adopt_labels``, which takes those of the first sample.
    """
    keys = F.map_keys("labels") if adopt_labels else F.array().cast("array<string>")
    unknown = valid_samples.join(metrics.select("name"), "name", "left_anti")
    kind = F.coalesce("type", F.lit("GAUGE"))
    return unknown.groupBy("name").agg(
        F.min_by(F.struct(kind.alias("type"), keys.alias("labels")), "idx").alias("first")
    ).select(
        "name", "first.type", F.lit(AUTO_DESCRIPTION).alias("description"),
        F.lit(None).cast("string").alias("unit"), "first.labels",
        F.lit(None).cast("int").alias("retention_days"),
    )


def update_metric(
    metrics: DataFrame,
    metric_id: str,
    as_of,
    retention_days: int | None = None,
    is_active: bool | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """The dimension with one metric changed."""
    if retention_days is not None and not 1 <= retention_days <= settings.max_retention_days:
        raise ValueError(f"retention days must lie in 1..{settings.max_retention_days}")
    changes = {"retention_days": retention_days, "is_active": is_active, "updated_at": None}
    here = F.col("id") == metric_id
    for column, value in changes.items():
        new = ts_lit(as_of) if column == "updated_at" else F.lit(value)
        if column == "updated_at" or value is not None:
            metrics = metrics.withColumn(column, F.when(here, new).otherwise(F.col(column)))
    return metrics


def deactivate_metric(metrics: DataFrame, metric_id: str, as_of) -> DataFrame:
    """Soft delete."""
    return update_metric(metrics, metric_id, as_of, is_active=False)
