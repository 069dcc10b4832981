"""Rollups as a stream: closed buckets are written once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesframe.functions.times import stream_window, utc_day
from seriesframe.operators.rollups import GRAINS
from seriesframe.schema import ROLLUP, SERIES
from seriesframe.session import scratch
from seriesframe.sources import tables
from seriesframe.streaming.ingest import start


def stream_rollup(samples: DataFrame, grain: str) -> DataFrame:
    """Bucket aggregates per series; samples later than the refresh band are not counted."""
    spec = GRAINS[grain]
    delay = f"{int(spec.refresh_start.total_seconds())} seconds"
    return (
        samples.withWatermark("time", delay)
        .groupBy(stream_window("time", spec.seconds).alias("w"), *SERIES)
        .agg(
            F.sum("value").alias("sum_value"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.count("value").alias("sample_count"),
        )
        .select(
            F.col("w.start").alias("bucket"), *SERIES,
            (F.col("sum_value") / F.col("sample_count")).alias("avg_value"),
            "sum_value", "min_value", "max_value", "sample_count",
        )
    )


def write_stream_rollup(
    samples: DataFrame, grain: str, path: str, checkpoint: str,
    available_now: bool = False, every: str | None = None,
) -> StreamingQuery:
    """Lay closed buckets over a rollup table, the same that batch refreshes write.

    A batch that is retried replaces its own buckets, and a later refresh corrects what came too
    late for the watermark.
    """

    def lay(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark) as keep:
            made = keep(batch.select(*ROLLUP.names), "closed")
            days = [row["day"] for row in made.select("day").distinct().collect()]
            if days:
                stored = tables.in_days(tables.read_table(spark, path, ROLLUP), days)
                kept = stored.join(made.select("bucket", *SERIES), ["bucket", *SERIES], "left_anti")
                tables.overwrite_days(kept.select(*ROLLUP.names).unionByName(made), path)

    rows = stream_rollup(samples, grain).withColumn("day", utc_day("bucket"))
    every = every or f"{int(GRAINS[grain].refresh_end.total_seconds())} seconds"
    return start(rows.writeStream.outputMode("append").foreachBatch(lay), checkpoint, available_now, every)
