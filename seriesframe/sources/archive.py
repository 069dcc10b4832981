"""Archive files: one folder per UTC day and metric, as parquet or gzip JSON.

The day comes first, so the daily job lists and reads only its own days however long the
archive grows, and a metric query opens just the folders its manifest rows name.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.functions.labels import from_key
from seriesframe.operators.archive import manifest_overlap
from seriesframe.operators.filters import filter_labels, filter_time
from seriesframe.operators.postings import days_with
from seriesframe.schema import ARCHIVE_JSON, SAMPLES
from seriesframe.sources.files import exists, names
from seriesframe.sources.tables import balanced

FORMATS = ("parquet", "json.gz")


def write_archive(
    samples: DataFrame, root: str, file_format: str = "parquet", base: str | None = None
) -> None:
    """Write samples below ``root/base``, replacing the (day, metric) folders they belong to.

    ``base`` is the format's own folder by default, and a new one where days are written again, so
    that files named in the manifest never change. Files are sorted by time, and a metric that
    holds most rows is spread over many files.
    """
    if file_format not in FORMATS:
        raise ValueError(f"unknown archive format {file_format!r}")
    ordered = balanced(samples, "day", "metric_id", "time", "labels_key")
    if file_format == "json.gz":
        # ISO text keeps microseconds, which a numeric epoch in milliseconds would cut.
        iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        ordered = ordered.select(
            iso.alias("timestamp"), "value", F.col("labels_key").alias("labels"), "day", "metric_id"
        )
    writer = (
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "metric_id")
    )
    if file_format == "parquet":
        writer.option("compression", "snappy").parquet(f"{root}/{base or file_format}")
    else:
        writer.option("compression", "gzip").json(f"{root}/{base or file_format}")


def _stored_in():
    path = F.regexp_extract("_metadata.file_path", r"([^/]+/day=[^/]+/metric_id=[^/]+)/[^/]+$", 1)
    return path.alias("storage_path")


def _format_of(base: str) -> str:
    return next(kind for kind in FORMATS if base == kind or base.startswith(f"{kind}."))


def _read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Samples in folders of one base, with their folder; a missing or unreadable one raises."""
    base = paths[0].split("/")[0]
    full = [f"{root}/{path}" for path in paths]
    if _format_of(base) == "parquet":
        found = spark.read.schema(SAMPLES).option("basePath", f"{root}/{base}").parquet(*full)
        return found.select(*SAMPLES.names, _stored_in())
    body = spark.read.schema(ARCHIVE_JSON).option("basePath", f"{root}/{base}").option("mode", "FAILFAST")
    return body.json(full).select(
        F.to_timestamp("timestamp").alias("time"), "metric_id", "value",
        from_key("labels").alias("labels"), F.col("labels").alias("labels_key"), "day", _stored_in(),
    )


def _read_all(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    by_base: dict[str, list[str]] = {}
    for path in paths:
        by_base.setdefault(path.split("/")[0], []).append(path)
    whole = spark.createDataFrame([], SAMPLES).withColumn("storage_path", F.lit(""))
    parts = [_read(spark, root, found) for found in by_base.values()]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0] if parts else whole


def _day_folders(spark: SparkSession, root: str, base: str, days: Iterable[date]) -> list[str]:
    folders = [f"{base}/day={day.isoformat()}" for day in sorted(set(days))]
    return [folder for folder in folders if exists(spark, f"{root}/{folder}")]


def read_archive_days(
    spark: SparkSession, root: str, manifest: DataFrame, days: Iterable[date]
) -> DataFrame:
    """All archived samples of the given days that the manifest names, whatever their metric."""
    days = list(days)
    folders = [f for base in names(spark, root) for f in _day_folders(spark, root, base, days)]
    found = _read_all(spark, root, folders)
    named = manifest.select("storage_path").distinct()
    return found.join(named, "storage_path", "left_semi").select(*SAMPLES.names)


def read_archive(
    spark: SparkSession, root: str, manifest: DataFrame, metric_id: str, start, end,
    labels: Mapping[str, str] | None = None, postings: DataFrame | None = None,
) -> DataFrame:
    """Archived samples of a metric in [start, end] with these labels, found through the manifest.

    With ``postings`` only the files of days that hold every label pair are opened. Only the
    folder names of one metric reach the driver: one per day of the range.
    """
    found = manifest_overlap(manifest, metric_id, start, end)
    if postings is not None:
        found = days_with(found, postings.filter(F.col("metric_id") == metric_id), labels)
    paths = [row["storage_path"] for row in found.select("storage_path").collect()]
    whole = _read_all(spark, root, paths).select(*SAMPLES.names)
    return filter_labels(filter_time(whole.filter(F.col("metric_id") == metric_id), start, end), labels)


def folder_sizes(spark: SparkSession, root: str, base: str, days: Iterable[date]) -> DataFrame:
    """Bytes per (metric, day); file listings only, no content is read."""
    folders = [f"{root}/{f}" for f in _day_folders(spark, root, base, days)]
    files = spark.read.format("binaryFile").option("basePath", f"{root}/{base}").load(folders)
    return files.groupBy(
        F.col("metric_id").cast("string").alias("metric_id"), F.col("day").cast("date").alias("day")
    ).agg(F.sum("length").alias("file_size_bytes"))
