"""Streaming ingest: NDJSON files in, validated batches out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from seriesframe.plans.store import SeriesStore
from seriesframe.schema import SAMPLE_KEY
from seriesframe.sources.samples import CORRUPT, ndjson_rows, ndjson_schema

FLUSH_INTERVAL = "5 seconds"


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool, every: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def read_sample_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw NDJSON lines with their file metadata, which orders arrivals within a batch."""
    reader = spark.readStream.schema(ndjson_schema()).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).select("*", "_metadata")


def stream_ingest(
    store: SeriesStore,
    path: str,
    checkpoint: str,
    source: str = "stream",
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    available_now: bool = False,
    every: str = FLUSH_INTERVAL,
    max_files: int | None = None,
    merge_every: int = 20,
) -> StreamingQuery:
    """Validate and land every micro-batch; accepted rows are visible after it.

    Once ``merge_every`` batches wait they are merged, so neither scans nor batches get slower
    the longer the stream runs.

    Lateness is judged by the stateless acceptance band around ``clock()``, not by a watermark.
    A batch that is retried keeps its place in the order, so nothing is stored twice and no newer
    value is overwritten.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        store.ingest(ndjson_rows(batch), clock(), batch=f"{source}-{batch_id}").release()
        if store.waiting_batches() >= merge_every:
            store.merge_incoming()

    raw = read_sample_stream(store.spark, path, max_files)
    return start(raw.writeStream.foreachBatch(land), checkpoint, available_now, every)


def dedup_first_wins(samples: DataFrame, delay: str) -> DataFrame:
    """Drop repeated keys in flight; the first arrival stays, state is bounded by the watermark.

    Where the last arrival has to win, land the batches with :func:`stream_ingest` instead.
    """
    return samples.withWatermark("time", delay).dropDuplicatesWithinWatermark(SAMPLE_KEY)
