"""Ingest rules as column expressions.

The first broken rule is the reject reason; NULL means accepted. The input has the columns
``idx, name, value, timestamp, labels, type``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.config import IngestLimits, Settings
from seriesframe.functions.labels import canonical_key, high_cardinality_keys, or_empty
from seriesframe.functions.times import ts_lit, utc

# The two name patterns, and what counts as blank.
METRIC_NAME_PATTERN = r"^[a-zA-Z][a-zA-Z0-9_.-]*\z"
LABEL_KEY_PATTERN = r"^[a-zA-Z][a-zA-Z0-9_]*\z"
BLANK_PATTERN = r"^[\s\p{Z}\x1c-\x1f]*\z"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_blank(text: Column | str) -> Column:
    return _col(text).isNull() | _col(text).rlike(BLANK_PATTERN)


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units, which the limits are stated in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def longer_than(text: Column | str, limit: int) -> Column:
    """A text has at most two units per character, so few texts need the exact count."""
    return (F.length(text) > limit // 2) & (utf16_length(text) > limit)


def first_problem(*problems: Column) -> Column:
    return F.coalesce(*problems)


def name_problem(name: Column | str, limits: IngestLimits = IngestLimits()) -> Column:
    return first_problem(
        F.when(is_blank(name), "name_blank"),
        F.when(longer_than(name, limits.max_name_length), "name_too_long"),
        F.when(~_col(name).rlike(METRIC_NAME_PATTERN), "name_invalid"),
    )


def value_problem(value: Column | str = "value") -> Column:
    value = _col(value)
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(value.isNull() | F.isnan(value) | infinite, "value_not_finite")


def time_problem(as_of, time: Column | str = "timestamp", limits: IngestLimits = IngestLimits()) -> Column:
    """Acceptance band around ``as_of``: stateless, not a watermark."""
    now = utc(as_of)
    latest = ts_lit(now + timedelta(seconds=limits.max_future_seconds))
    earliest = ts_lit(now - timedelta(days=limits.max_past_days))
    return first_problem(
        F.when(_col(time) > latest, "timestamp_in_future"),
        F.when(_col(time) < earliest, "timestamp_too_old"),
    )


def label_problem(labels: Column | str = "labels", limits: IngestLimits = IngestLimits()) -> Column:
    """First problem of the first bad label, in the order the sample lists them."""
    each = F.transform(F.map_entries(or_empty(labels)), lambda pair: F.coalesce(
        F.when(is_blank(pair["key"]), "label_key_blank"),
        F.when(longer_than(pair["key"], limits.max_label_key_length), "label_key_too_long"),
        F.when(~pair["key"].rlike(LABEL_KEY_PATTERN), "label_key_invalid"),
        F.when(is_blank(pair["value"]), "label_value_blank"),
        F.when(longer_than(pair["value"], limits.max_label_value_length), "label_value_too_long"),
    ))
    return F.get(F.array_compact(each), 0)


def missing_labels(labels: Column | str, registered: Column | str) -> Column:
    return F.array_sort(F.array_except(_col(registered), F.map_keys(or_empty(labels))))


def extra_labels(labels: Column | str, registered: Column | str) -> Column:
    return F.array_sort(F.array_except(F.map_keys(or_empty(labels)), _col(registered)))


def sample_problem(as_of, settings: Settings = Settings()) -> Column:
    """Rules that need nothing but the sample; they come before auto-registration."""
    return first_problem(
        name_problem("name", settings.ingest),
        value_problem(),
        time_problem(as_of, limits=settings.ingest),
    )


def schema_problem(settings: Settings = Settings()) -> Column:
    """Label rules and the registered label set, in ``label_keys``."""
    keys = F.map_keys(or_empty("labels"))
    return first_problem(
        label_problem("labels", settings.ingest),
        F.when(F.size(F.array_except("label_keys", keys)) > 0, "missing_labels"),
        F.when(F.size(F.array_except(keys, F.col("label_keys"))) > 0, "extra_labels"),
    )


def cardinality_problem(settings: Settings = Settings(), over_limit: Column | None = None) -> Column:
    """Cardinality rules; all broken ones are listed, joined by ``; ``."""
    limits = settings.cardinality
    labels = or_empty("labels")
    longest = limits.max_label_value_length
    long_values = F.transform(F.map_entries(labels), lambda pair: F.when(
        longer_than(pair["value"], longest),
        F.concat(F.lit("label_value_over_limit:"), pair["key"]),
    ))
    too_many = F.size(labels) > limits.max_labels_per_metric
    full = F.lit(False) if over_limit is None else over_limit
    found = F.array_compact(F.concat(
        F.array(F.when(too_many, "label_count_over_limit")), long_values,
        F.array(F.when(full, "series_over_limit")),
    ))
    return F.nullif(F.array_join(found, "; "), F.lit(""))


def cardinality_warnings(settings: Settings = Settings(), series: Column | None = None) -> Column:
    """Warnings never reject: suspicious label keys, and a metric close to its series limit."""
    limits = settings.cardinality
    keys = F.transform(
        high_cardinality_keys("labels"),
        lambda key: F.concat(F.lit("high_cardinality_label:"), key),
    )
    if series is None:
        return keys
    near = (series > limits.max_series_per_metric * limits.warning_threshold) & (
        series < limits.max_series_per_metric
    )
    return F.array_compact(F.concat(keys, F.array(F.when(near, "series_near_limit"))))


def attach_registry(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join with the registered metrics: ``name, metric_id, label_keys``.

    A hot name would be one skewed key of a shuffle join, which AQE splits; while the registry
    is small Spark broadcasts it and no sample moves.
    """
    return incoming.join(
        registry.select("name", F.col("id").alias("metric_id"), "label_keys"), "name", "left"
    )


def normalize(incoming: DataFrame, as_of) -> DataFrame:
    """Defaults of a request: no timestamp means ``as_of``, no labels the empty set."""
    return incoming.withColumn(
        "timestamp", F.coalesce(F.col("timestamp").cast("timestamp"), ts_lit(as_of))
    ).withColumn("labels", or_empty("labels")).withColumn("labels_key", canonical_key("labels"))


def split_summary(validated: DataFrame) -> DataFrame:
    """Accepted and rejected counts per reason."""
    status = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status")
    return validated.groupBy(status, "reason").agg(F.count(F.lit(1)).alias("samples"))
