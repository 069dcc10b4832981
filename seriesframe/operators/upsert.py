"""Last-wins merging of samples on (metric, label set, time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.labels import from_key
from seriesframe.functions.times import utc_day
from seriesframe.schema import SAMPLE_KEY


def last_wins(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per key: the value that arrived last.

    ``max_by`` combines on the map side, so many copies of one key never meet in one task. One
    BIGINT order column keeps the aggregate in hash form; several are compared as a struct.
    """
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return rows.groupBy(*SAMPLE_KEY).agg(F.max_by("value", by).alias("value"))


def as_samples(keyed: DataFrame) -> DataFrame:
    """Stored form of merged rows: the label map and the day follow from the key."""
    return keyed.select(
        "time", "metric_id", "value", from_key("labels_key").alias("labels"), "labels_key",
        utc_day("time").alias("day"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, order: str = "landed") -> DataFrame:
    """Stored samples (one per key) with incoming ones laid over them, the highest ``order`` first.

    Stored rows are only checked against the incoming keys: while these are few they are
    broadcast and no stored row is shuffled.
    """
    fresh = last_wins(incoming, [order])
    kept = stored.join(fresh.select(*SAMPLE_KEY), SAMPLE_KEY, "left_anti")
    made = as_samples(fresh)
    return kept.select(*made.columns).unionByName(made)
