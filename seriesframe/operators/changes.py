"""Incremental rollup refresh: from changed samples to changed buckets, reading nothing else.

A change is a sample's old and new value. Changes sum up to one delta per bucket and series. Sums
and counts take the signed delta; a minimum or maximum takes what was added, unless the extreme
itself was taken back and nothing added reaches as far: then, and only then, the samples of
that bucket are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesframe.functions.times import time_bucket
from seriesframe.operators.rollups import GRAINS
from seriesframe.schema import SAMPLE_KEY, SERIES

_CELL = ["bucket", *SERIES]


def sample_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """time, series, old_value and new_value of every key that ``incoming`` adds or alters.

    Both hold one row per key. An incoming row without a value takes the stored sample back. Rows
    that change nothing are left out. While the incoming rows are few, no stored row is shuffled.
    """
    fresh = incoming.select(*SAMPLE_KEY, F.col("value").alias("new_value"))
    old = stored.select(*SAMPLE_KEY, F.col("value").alias("old_value"))
    return fresh.join(old, SAMPLE_KEY, "left").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def bucket_deltas(changes: DataFrame, grain: str) -> DataFrame:
    """What the changes come to per bucket and series.

    ``sum_delta`` and ``count_delta`` are signed; ``add_min``/``add_max`` are the extremes of the new
    values, ``gone_min``/``gone_max`` those of the old ones.
    """
    new, old = F.col("new_value"), F.col("old_value")
    bucket = time_bucket("time", GRAINS[grain].seconds).alias("bucket")
    return changes.groupBy(bucket, *SERIES).agg(
        (F.coalesce(F.sum(new), F.lit(0.0)) - F.coalesce(F.sum(old), F.lit(0.0))).alias("sum_delta"),
        (F.count(new) - F.count(old)).alias("count_delta"),
        F.min(new).alias("add_min"), F.max(new).alias("add_max"),
        F.min(old).alias("gone_min"), F.max(old).alias("gone_max"),
    )


def changed_intervals(deltas: DataFrame, grain: str) -> DataFrame:
    """metric_id, day, begin, end (exclusive) and buckets: runs of neighbouring changed buckets.

    The change table of a refresh. Runs end with the day, so a window holds one day's buckets of
    one metric at most.
    """
    seconds = GRAINS[grain].seconds
    cells = deltas.select("metric_id", F.to_date("bucket").alias("day"), "bucket").distinct()
    in_order = Window.partitionBy("metric_id", "day").orderBy("bucket")
    island = (F.unix_seconds("bucket") / seconds).cast("long") - F.row_number().over(in_order)
    runs = cells.withColumn("island", island).groupBy("metric_id", "day", "island").agg(
        F.min("bucket").alias("begin"), F.max("bucket").alias("last"), F.count("*").alias("buckets")
    )
    end = F.timestamp_seconds(F.unix_seconds("last") + seconds).alias("end")
    return runs.select("metric_id", "day", "begin", end, "buckets")


def _cells_and_deltas(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """Deltas with the rollup rows they change; ``lost_min``/``lost_max`` ask for a new look."""
    def lost(gone: Column, extreme: Column, add: Column, beyond) -> Column:
        return F.coalesce((gone == extreme) & (add.isNull() | beyond(add, extreme)), F.lit(False))

    rows = table.select(*_CELL, "sum_value", "min_value", "max_value", "sample_count")
    met = deltas.join(rows, _CELL, "left")
    count = (F.coalesce("sample_count", F.lit(0)) + F.col("count_delta")).cast("long")
    low, high = F.col("min_value"), F.col("max_value")
    return met.select(
        *_CELL, count.alias("sample_count"),
        (F.coalesce("sum_value", F.lit(0.0)) + F.col("sum_delta")).alias("sum_value"),
        F.least(low, "add_min").alias("min_value"), F.greatest(high, "add_max").alias("max_value"),
        lost(F.col("gone_min"), low, F.col("add_min"), lambda a, x: a > x).alias("lost_min"),
        lost(F.col("gone_max"), high, F.col("add_max"), lambda a, x: a < x).alias("lost_max"),
    )


def lost_extremes(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """bucket and series of the cells whose samples must be read again."""
    met = _cells_and_deltas(table, deltas)
    return met.filter((F.col("lost_min") | F.col("lost_max")) & (F.col("sample_count") > 0)).select(*_CELL)


def samples_of(cells: DataFrame, samples: DataFrame, grain: str) -> DataFrame:
    """The samples of some cells; days without any are not read where samples are kept by day."""
    seconds = GRAINS[grain].seconds
    rows = samples.withColumn("bucket", time_bucket("time", seconds))
    keys = _CELL
    if "day" in samples.columns and seconds <= GRAINS["1d"].seconds:
        cells, keys = cells.withColumn("day", F.to_date("bucket")), ["day", *_CELL]
    return rows.join(cells, keys, "left_semi")


def refreshed_cells(table: DataFrame, deltas: DataFrame, samples: DataFrame, grain: str) -> DataFrame:
    """The new rows of the changed cells; a cell without samples is left out.

    ``table`` is the rollup before the changes, ``samples`` are those after them.
    """
    again = samples_of(lost_extremes(table, deltas), samples, grain).groupBy(*_CELL).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    made = _cells_and_deltas(table, deltas).filter("sample_count > 0").join(again, _CELL, "left")
    return made.select(
        *_CELL, (F.col("sum_value") / F.col("sample_count")).alias("avg_value"), "sum_value",
        F.when(F.col("lost_min"), F.col("low")).otherwise(F.col("min_value")).alias("min_value"),
        F.when(F.col("lost_max"), F.col("high")).otherwise(F.col("max_value")).alias("max_value"),
        "sample_count",
    )


def refresh(table: DataFrame, deltas: DataFrame, samples: DataFrame, grain: str) -> DataFrame:
    """The whole rollup after the changes: cells without changes as they were, the others anew.

    Equal to a rollup of the samples, but for the rounding of sums.
    """
    made = refreshed_cells(table, deltas, samples, grain)
    kept = table.join(deltas.select(*_CELL), _CELL, "left_anti")
    return kept.select(*made.columns).unionByName(made)
