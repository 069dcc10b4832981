"""Schemas of the stored tables and of the incoming data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _TS, _DATE, _B = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType(),
    T.DateType(), T.BooleanType(),
)
LABELS = T.MapType(_S, _S)


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in cols.items()])


# A series is (metric_id, labels_key); labels_key is the canonical text of labels.
SERIES = ["metric_id", "labels_key"]
SAMPLE_KEY = ["metric_id", "labels_key", "time"]

METRICS = _struct(
    id=_S, name=_S, type=_S, description=_S, unit=_S, retention_days=_I, is_active=_B,
    created_at=_TS, updated_at=_TS,
)
METRIC_LABELS = _struct(metric_id=_S, label_key=_S)
SAMPLES = _struct(time=_TS, metric_id=_S, value=_D, labels=LABELS, labels_key=_S, day=_DATE)
# Accepted rows of one ingest batch, not yet merged into the day partitions.
INCOMING = _struct(
    time=_TS, metric_id=_S, value=_D, labels_key=_S, landed=_L, batch=_S, day=_DATE,
)
# Series seen per day, with their newest sample: what the series limit is counted on.
SERIES_SEEN = _struct(metric_id=_S, labels_key=_S, time=_TS, day=_DATE)
ROLLUP = _struct(
    bucket=_TS, metric_id=_S, labels_key=_S, avg_value=_D, sum_value=_D, min_value=_D,
    max_value=_D, sample_count=_L, day=_DATE,
)
MANIFEST = _struct(
    id=_S, metric_id=_S, day=_DATE, start_time=_TS, end_time=_TS, storage_path=_S,
    row_count=_L, file_size_bytes=_L, file_format=_S,
    compression_ratio=T.DecimalType(5, 4), series_count=_L, created_at=_TS,
)
LABELS_INDEX = _struct(metric_id=_S, day=_DATE, labels_key=_S, row_count=_L)
# Bitmaps over day numbers: the archived days of a metric that hold a label pair.
POSTINGS = _struct(metric_id=_S, label_key=_S, label_value=_S, bucket=_L, bitmap=T.BinaryType())
RUNS = _struct(
    id=_S, job_type=_S, status=_S, start_time=_TS, end_time=_TS, metrics_processed=_I,
    rows_migrated=_L, error_message=_S, created_at=_TS, updated_at=_TS,
)

# Wire format of one sample; the timestamp stays text so a bad one can be named in the reject.
SAMPLE_REQUEST = _struct(name=_S, value=_D, timestamp=_S, labels=LABELS, type=_S)
BATCH_REQUEST = _struct(metrics=T.ArrayType(SAMPLE_REQUEST))
REGISTRATION = _struct(
    name=_S, type=_S, description=_S, unit=_S, labels=T.ArrayType(_S), retention_days=_I,
)
ARCHIVE_JSON = _struct(timestamp=_S, metric_id=_S, value=_D, labels=_S, day=_DATE)

METRIC_TYPES = ("COUNTER", "GAUGE", "HISTOGRAM", "SUMMARY")
