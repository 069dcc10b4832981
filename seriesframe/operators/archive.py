"""Archive bookkeeping: what to archive, the manifest, and hot + cold in one view."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.times import DAY_SECONDS, day_of, ts_lit, utc
from seriesframe.operators.filters import filter_age
from seriesframe.schema import SAMPLE_KEY

METRIC_DAY = ["metric_id", "day"]


def cutoff_day(as_of, days: int = 30) -> date:
    """Days before this one are complete and old enough to be archived."""
    return day_of(utc(as_of) - timedelta(days=days))


def metrics_before(samples: DataFrame, cutoff) -> DataFrame:
    """Distinct metrics with samples older than the cutoff."""
    return filter_age(samples, cutoff).select("metric_id").distinct()


def archived_metrics(manifest: DataFrame) -> DataFrame:
    return manifest.select("metric_id").distinct()


def archive_candidates(samples: DataFrame, manifest: DataFrame, before: date) -> DataFrame:
    """(metric, day, row_count) of complete days that are not in the manifest yet."""
    days = (
        samples.filter(F.col("day") < F.lit(before))
        .groupBy(*METRIC_DAY).agg(F.count(F.lit(1)).alias("row_count"))
    )
    return days.join(manifest.select(*METRIC_DAY), METRIC_DAY, "left_anti")


def archive_directory(base: str = "parquet") -> Column:
    """Folder of one metric and UTC day below the archive root."""
    return F.format_string(
        f"{base}/day=%s/metric_id=%s", F.col("day").cast("string"), F.col("metric_id")
    )


def manifest_rows(
    index: DataFrame, as_of, file_format: str = "parquet", base: str | None = None
) -> DataFrame:
    """One manifest row per metric and day of a label index; sizes are joined once files exist."""
    start = F.col("day").cast("timestamp")
    return (
        index.groupBy(*METRIC_DAY)
        .agg(F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("series_count"))
        .select(
            F.md5(F.concat_ws("/", "metric_id", "day")).alias("id"), *METRIC_DAY,
            start.alias("start_time"),
            F.timestamp_micros(
                F.unix_micros(start) + F.lit(DAY_SECONDS * 1_000_000)
            ).alias("end_time"),
            archive_directory(base or file_format).alias("storage_path"),
            "row_count", F.lit(file_format).alias("file_format"),
            F.lit(None).cast("decimal(5,4)").alias("compression_ratio"),
            "series_count", ts_lit(as_of).alias("created_at"),
        )
    )


def labels_index(archived: DataFrame) -> DataFrame:
    """The label sets in each archived (metric, day), one row each.

    Kept as rows, not as one array per file, so a metric with very many series stays spread.
    """
    return archived.groupBy(*METRIC_DAY, "labels_key").agg(F.count(F.lit(1)).alias("row_count"))


def manifest_overlap(manifest: DataFrame, metric_id: str, start, end) -> DataFrame:
    """Manifest rows of a metric that touch [start, end], oldest first."""
    touching = (F.col("start_time") <= ts_lit(end)) & (F.col("end_time") >= ts_lit(start))
    days = F.col("day").between(
        F.lit(day_of(utc(start)) - timedelta(days=1)), F.lit(day_of(end))
    )
    return manifest.filter((F.col("metric_id") == metric_id) & days & touching).orderBy("start_time")


# Days are numbered from here, so that none of the calendar is negative.
_DAY_ZERO = 1 << 20


def _day_number(time: Column) -> Column:
    return F.unix_date(F.to_date(time)) + _DAY_ZERO


def dyadic_cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest aligned blocks of 1, 2, 4, ... days that tile the days ``first`` to ``last``.

    An array of (level, block): block b of level k holds the days b * 2^k up to (b + 1) * 2^k - 1.
    There are at most two of each level.
    """
    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), level.cast("int"))
        low = F.floor((first + size - 1) / size).cast("int")
        high = F.floor((last + 1) / size).cast("int")
        inside = low < high

        def block(number: Column) -> Column:
            return F.struct(level.cast("int").alias("level"), number.cast("int").alias("block"))

        return F.array(F.when(inside & (low % 2 == 1), block(low)), F.when(inside & (high % 2 == 1), block(high - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level)))


def manifest_for_ranges(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Manifest rows touching any of many ranges ``query_id, metric_id, start, end``, of any length.

    A manifest row covers one day. A range is cut into aligned blocks of days, at most two of each
    power of two, and a manifest row is a key of the one block per level that its day lies in. So an
    equi-join finds each pair once, and rows grow with the logarithm of a range's length. The
    day before is added because a file's end touches the next midnight. Looks at the longest
    range first, since that gives the number of levels.
    """
    days = ranges.withColumns({
        "first_day": _day_number(F.col("start")) - 1, "last_day": _day_number(F.col("end")),
    })
    longest = days.agg(F.max(F.col("last_day") - F.col("first_day"))).first()[0] or 0
    levels = max(0, longest + 1).bit_length()
    blocks = days.withColumn("at", F.explode(dyadic_cover(F.col("first_day"), F.col("last_day"), levels)))
    blocks = blocks.select(*ranges.columns, "at.level", "at.block")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    keyed = manifest.select("*", level).withColumn(
        "block", F.call_function("shiftright", _day_number(F.col("day")), F.col("level"))
    )
    return blocks.join(keyed, ["metric_id", "level", "block"]).drop("level", "block").filter(
        (F.col("start_time") <= F.col("end")) & (F.col("end_time") >= F.col("start"))
    )


def recent_archives(manifest: DataFrame, metric_id: str, limit: int = 10) -> DataFrame:
    found = manifest.filter(F.col("metric_id") == metric_id)
    return found.orderBy(F.col("start_time").desc()).limit(limit)


def archive_stats(manifest: DataFrame) -> DataFrame:
    """Files, rows and bytes per archived metric."""
    return manifest.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("row_count").alias("total_rows"),
        F.sum("file_size_bytes").alias("total_size"),
    )


def archive_totals(manifest: DataFrame) -> DataFrame:
    """Distinct metrics, rows and gigabytes in the archive."""
    return manifest.agg(
        F.countDistinct("metric_id").alias("metrics_archived"),
        F.sum("row_count").alias("total_rows"),
        (F.sum("file_size_bytes") / F.lit(1024.0**3)).alias("total_gb"),
    )


def archive_lag(samples: DataFrame, as_of) -> DataFrame:
    """Oldest hot sample and its age in seconds."""
    oldest = F.min("time").alias("oldest")
    age = (F.unix_micros(ts_lit(as_of)) - F.unix_micros("oldest")) / F.lit(1e6)
    return samples.agg(oldest).select("oldest", age.alias("age_seconds"))


def unified_scan(
    hot: DataFrame, cold: DataFrame, shared_days: Iterable[date] | None = None
) -> DataFrame:
    """Hot and cold samples as one table; where both hold a sample the hot one counts.

    Only days found on both sides need the anti join. ``shared_days`` names them (the store
    reads them off its directories); None compares every day.
    """
    if shared_days is None:
        return hot.unionByName(cold.join(hot.select(*SAMPLE_KEY), SAMPLE_KEY, "left_anti"))
    days = [F.lit(day) for day in sorted(set(shared_days))]
    if not days:
        return hot.unionByName(cold)
    shared = F.col("day").isin(days)
    fresh = cold.filter(shared).join(
        hot.filter(shared).select(*SAMPLE_KEY), SAMPLE_KEY, "left_anti"
    )
    return hot.unionByName(cold.filter(~shared)).unionByName(fresh.select(*cold.columns))


def kept_in_hot(hot: DataFrame, archived: DataFrame) -> DataFrame:
    """Hot rows that the archive does not hold with the same value: late or corrected ones."""
    proof = [*SAMPLE_KEY, "value"]
    return hot.join(archived.select(*proof), proof, "left_anti").select(*hot.columns)


def purge_manifest(manifest: DataFrame, cutoff) -> DataFrame:
    """The manifest without rows created before the cutoff."""
    return manifest.filter(F.col("created_at") >= ts_lit(cutoff))
