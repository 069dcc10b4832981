"""Export of query points as JSON lines, CSV or Prometheus text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.labels import canonical_key, prometheus_labels

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def json_lines(points: DataFrame, metric: str) -> DataFrame:
    """Points ``timestamp, value, labels`` with ISO-8601 timestamps."""
    return points.select(
        F.date_format("timestamp", ISO).alias("timestamp"), F.lit(metric).alias("metric"),
        "value", "labels",
    )


def csv_rows(points: DataFrame, metric: str) -> DataFrame:
    return points.select(
        F.date_format("timestamp", ISO).alias("timestamp"), F.lit(metric).alias("metric"),
        "value", canonical_key("labels").alias("labels"),
    )


def prometheus_lines(points: DataFrame, metric: str) -> DataFrame:
    """``name{k="v"} value epoch_millis`` in one text column."""
    return points.select(F.concat(
        F.lit(metric), prometheus_labels("labels"), F.lit(" "), F.col("value").cast("string"),
        F.lit(" "), F.unix_millis("timestamp").cast("string"),
    ).alias("value"))


def export(points: DataFrame, metric: str, file_format: str, path: str) -> None:
    """Write points to ``path`` in the given format: JSON, CSV or PROMETHEUS."""
    kind = file_format.upper()
    if kind == "JSON":
        json_lines(points, metric).write.json(path)
    elif kind == "CSV":
        csv_rows(points, metric).write.option("header", True).option("escape", '"').csv(path)
    elif kind == "PROMETHEUS":
        prometheus_lines(points, metric).write.text(path)
    else:
        raise ValueError(f"unknown export format {file_format!r}")
