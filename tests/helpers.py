"""Small samples for tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from seriesframe.functions.labels import canonical_key
from seriesframe.schema import SAMPLES

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def samples(spark, rows):
    """Rows of (seconds after T0, metric, value, labels)."""
    made = spark.createDataFrame(
        [(None if s is None else at(s), metric, float(value), labels) for s, metric, value, labels in rows],
        "time timestamp, metric_id string, value double, labels map<string,string>",
    )
    return made.withColumn("labels_key", canonical_key("labels")).withColumn(
        "day", F.to_date("time")
    ).select(*SAMPLES.names)


def incoming(spark, rows):
    """Rows of (idx, name, value, seconds after T0, labels, type)."""
    return spark.createDataFrame(
        [(i, n, None if x is None else float(x), None if s is None else at(s), la, t)
         for i, n, x, s, la, t in rows],
        "idx long, name string, value double, timestamp timestamp, labels map<string,string>, type string",
    )


def registrations(spark, rows):
    """Rows of (idx, name, type, labels, retention_days)."""
    return spark.createDataFrame(
        [(i, n, t, "about " + str(n), "unit", la, r) for i, n, t, la, r in rows],
        "idx long, name string, type string, description string, unit string, labels array<string>, retention_days int",
    )


def tuples(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())
