"""Posting bitmaps: which archived days of a metric hold a label pair.

A posting is a bitmap over day numbers, one row per metric, label pair and block of 32768 days, so
it stays as small as the label sets are few, however many samples a day has. A read with labels
asks for the days on which all its pairs occur and opens only their files. A day may still hold no
series with all pairs at once; the filter on rows decides that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.labels import from_key

_PAIR = ["metric_id", "label_key", "label_value", "bucket"]
# A pair that every indexed day has: days without it are not indexed and never left out.
EVERY_DAY = ("", "")


def _day_number(day: Column) -> Column:
    return F.unix_date(day).cast("long") + F.lit(1 << 20)


def label_postings(index: DataFrame) -> DataFrame:
    """metric_id, label_key, label_value, bucket, bitmap of rows (metric_id, day, labels_key).

    Each label set is unfolded once per day; bitmaps are built on the map side.
    """
    pairs = F.map_entries(from_key("labels_key"))
    every = F.array(F.struct(F.lit(EVERY_DAY[0]).alias("key"), F.lit(EVERY_DAY[1]).alias("value")))
    rows = index.select("metric_id", _day_number(F.col("day")).alias("number"), F.explode(F.concat(pairs, every)).alias("pair"))
    return rows.groupBy(
        "metric_id", F.col("pair.key").alias("label_key"), F.col("pair.value").alias("label_value"),
        F.bitmap_bucket_number("number").alias("bucket"),
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def merge_postings(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Both together; a day that lost a pair since keeps it, which costs a read and no result."""
    return postings.select(*_PAIR, "bitmap").unionByName(more.select(*_PAIR, "bitmap")).groupBy(*_PAIR).agg(
        F.bitmap_or_agg("bitmap").alias("bitmap")
    )


def _has(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def days_with(files: DataFrame, postings: DataFrame, labels: Mapping[str, str] | None) -> DataFrame:
    """The rows of ``files`` (metric_id, day, ...), each its own (metric, day), whose days have every pair of ``labels``.

    Days that are not indexed stay. Only the postings of the asked pairs are read.
    """
    if not labels:
        return files
    asked = F.lit(False)
    for key, value in [*labels.items(), EVERY_DAY]:
        asked = asked | ((F.col("label_key") == key) & (F.col("label_value") == value))
    known = (F.col("label_key") == EVERY_DAY[0]) & (F.col("label_value") == EVERY_DAY[1])
    number = _day_number(F.col("day"))
    keyed = files.select("metric_id", "day").withColumns(
        {"bucket": F.bitmap_bucket_number(number), "position": F.bitmap_bit_position(number)}
    )
    met = keyed.join(postings.filter(asked), ["metric_id", "bucket"]).filter(_has(F.col("bitmap"), F.col("position")))
    seen = met.groupBy("metric_id", "day").agg(F.count(F.when(~known, 1)).alias("pairs"), F.max(known).alias("known"))
    without = seen.filter(F.col("known") & (F.col("pairs") < len(labels))).select("metric_id", "day")
    return files.join(without, ["metric_id", "day"], "left_anti")
