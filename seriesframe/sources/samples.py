"""Incoming samples (JSON batches, NDJSON) and the stored fact table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from seriesframe.functions.labels import distinct_labels
from seriesframe.functions.times import day_of, parse_iso
from seriesframe.operators.filters import filter_labels, filter_metric, filter_time
from seriesframe.operators.validation import is_blank
from seriesframe.schema import BATCH_REQUEST, SAMPLE_REQUEST, SAMPLES
from seriesframe.session import materialize
from seriesframe.sources.tables import read_table

CORRUPT = "_corrupt"


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def _arrival(position: Column) -> Column:
    """Total order of arrival: file time, file, block within it, position within that."""
    return F.struct(
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        position.cast("long").alias("position"),
    ).alias("arrival")


def _problem(*reasons: Column) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def _typed(rows: DataFrame) -> DataFrame:
    """Timestamp text to timestamp; text that is not blank and not readable is a problem.

    Labels get one value per key, so a line that repeats one cannot stop a job.
    """
    text = F.col("timestamp")
    unreadable = F.when(
        ~is_blank(text) & parse_iso(text).isNull(),
        F.concat(F.lit("timestamp_invalid:"), text),
    )
    return rows.withColumn("problem", F.coalesce("problem", unreadable)).withColumns(
        {"timestamp": parse_iso(text), "labels": distinct_labels("labels")}
    )


def read_samples_json(
    spark: SparkSession, path: str, max_batch: int | None = None
) -> DataFrame:
    """Batches ``{"metrics": [...]}``, one per file, as rows with their index in the batch.

    With ``max_batch`` every sample of a longer batch carries the problem ``batch_too_large``;
    an unreadable file or an empty batch is one row with a problem.
    """
    raw = (
        spark.read.schema(_with_corrupt(BATCH_REQUEST))
        .option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )
    size = F.coalesce(F.size("metrics"), F.lit(0))
    too_large = F.lit(False) if max_batch is None else size > max_batch
    rows = raw.select(
        _arrival(F.lit(0)),
        _problem(
            F.when(F.col(CORRUPT).isNotNull(), "malformed"),
            F.when(size < 1, "batch_empty"),
            F.when(too_large, "batch_too_large"),
        ).alias("problem"),
        F.posexplode_outer("metrics").alias("idx", "sample"),
    )
    return _typed(rows.select(
        F.coalesce(F.col("idx").cast("long"), F.lit(0).cast("long")).alias("idx"), "sample.*",
        F.col("arrival").withField("position", F.coalesce("idx", F.lit(0)).cast("long")).alias("arrival"),
        "problem",
    ))


def ndjson_rows(raw: DataFrame) -> DataFrame:
    """Rows of an NDJSON scan, batch or streaming; a malformed line keeps its text in ``name``."""
    position = F.monotonically_increasing_id()
    return _typed(raw.select(
        position.alias("idx"), F.coalesce("name", CORRUPT).alias("name"),
        "value", "timestamp", "labels", "type", _arrival(position),
        _problem(F.when(F.col(CORRUPT).isNotNull(), "malformed")).alias("problem"),
    ))


def ndjson_schema() -> StructType:
    return _with_corrupt(SAMPLE_REQUEST)


def number_lines(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan of files, with ``idx``: the position of a row in its file, from 0.

    Rows of a file split stand in one task, in order. A first pass counts the rows of every split, and
    a row's position is its place in the split after those of the splits before it: one small
    row per split is all that is gathered. Both passes must see the same splits, as they do
    while the session's settings and its cores stay; if not, the job fails.
    """
    split = [F.col("_metadata.file_path").alias("split_file"), F.col("_metadata.file_block_start").alias("split_start")]
    placed = rows.select("*", *split, F.monotonically_increasing_id().alias("split_place"))
    counts = placed.groupBy("split_file", "split_start").agg(
        F.count("*").alias("split_rows"), F.min("split_place").alias("split_first")
    )
    counts = materialize(counts, "line-counts")
    earlier = Window.partitionBy("split_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "split_file", "split_start",
        (F.coalesce(F.sum("split_rows").over(earlier), F.lit(0)) - F.col("split_first")).alias("split_base"),
    )
    found = placed.join(bases, ["split_file", "split_start"], "left")
    idx = F.coalesce(
        F.col("split_base") + F.col("split_place"),
        F.raise_error(F.lit("the files were split otherwise than when their lines were counted")).cast("long"),
    )
    return found.withColumn("idx", idx).drop("split_file", "split_start", "split_place", "split_base")


def read_samples_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One sample per line; ``idx`` is the line's position in its file, blank lines not counted."""
    raw = spark.read.schema(ndjson_schema()).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return number_lines(ndjson_rows(raw).drop("idx"))


def scan_samples(
    spark: SparkSession,
    path: str,
    metric_id: str | None = None,
    start=None,
    end=None,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Fact scan: other days are not even listed, metric and time reach the parquet reader."""
    first, last = (None, None) if start is None else (day_of(start), day_of(end))
    found = read_table(spark, path, SAMPLES, first, last)
    if metric_id is not None:
        found = filter_metric(found, metric_id)
    if start is not None:
        found = filter_time(found, start, end)
    return filter_labels(found, labels)
