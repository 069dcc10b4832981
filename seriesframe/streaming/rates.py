"""Counter rates as a stream: every sample finds its neighbours, however late it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from seriesframe.functions.times import utc_day
from seriesframe.operators import counters
from seriesframe.schema import SAMPLE_KEY, SAMPLES, SERIES
from seriesframe.session import scratch
from seriesframe.sources.files import delete, exists, partitions
from seriesframe.sources.tables import compact
from seriesframe.streaming.ingest import start

VALUE = [*SAMPLE_KEY, "value"]
HELD = StructType([*(SAMPLES[name] for name in VALUE), StructField("batch", LongType()), SAMPLES["day"]])
# First and last sample of a series and day, as known after a batch.
POINT = StructType([SAMPLES["time"], StructField("batch", LongType()), SAMPLES["value"]])
EDGES = StructType([
    *(SAMPLES[name] for name in (*SERIES, "day")), StructField("first", POINT), StructField("last", POINT),
])
RATES = StructType([*(SAMPLES[name] for name in ("time", *SERIES)), StructField("rate", SAMPLES["value"].dataType)])
MERGE_AFTER = 64


def newest_values(rows: DataFrame) -> DataFrame:
    """One row per series and time: the value of the latest batch."""
    return rows.groupBy(*SAMPLE_KEY, "day").agg(
        F.max_by("value", "batch").alias("value"), F.max("batch").alias("batch")
    ).select(*HELD.names)


def day_edges(rows: DataFrame) -> DataFrame:
    """First and last sample per series and day; of equal times the latest batch's value counts."""
    point = F.struct("time", "batch", "value")
    return rows.groupBy(*SERIES, "day").agg(
        F.min_by(point, F.struct("time", -F.col("batch"))).alias("first"),
        F.max_by(point, F.struct("time", "batch")).alias("last"),
    )


def outer_edges(edges: DataFrame) -> DataFrame:
    """The same from edges of several batches."""
    return edges.groupBy(*SERIES, "day").agg(
        F.min_by("first", F.struct("first.time", -F.col("first.batch"))).alias("first"),
        F.max_by("last", F.struct("last.time", "last.batch")).alias("last"),
    )


class _Held:
    """Rows that earlier batches left: one folder per batch, and one per ``MERGE_AFTER`` batches."""

    def __init__(self, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame]):
        self.path, self.schema, self.merge = path, schema, merge

    def write(self, rows: DataFrame, folder: str) -> None:
        compact(rows, "day", *SERIES).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/{folder}")

    def read(self, spark: SparkSession, kind: str, low: int, high: int, days=None) -> DataFrame:
        """Folders ``low`` up to, but without, ``high``; of certain days only, if given."""
        names = [n for n in partitions(spark, self.path, kind) if low <= int(n) < high]
        found = spark.createDataFrame([], self.schema)
        if names:
            read = spark.read.schema(self.schema).option("basePath", self.path)
            found = read.parquet(*(f"{self.path}/{kind}={n}" for n in names)).select(*self.schema.names)
        return found if days is None else found.filter(F.col("day").isin(days))

    def before(self, spark: SparkSession, batch_id: int, days=None) -> DataFrame:
        """What batches before ``batch_id`` left; a retry sees the same."""
        runs = batch_id // MERGE_AFTER
        whole = self.read(spark, "run", 0, runs, days)
        return whole.unionByName(self.read(spark, "batch", runs * MERGE_AFTER, batch_id, days))

    def tidy(self, spark: SparkSession, batch_id: int) -> None:
        """At the start of a run: merge the batches of the last one, drop those merged before it."""
        run, inside = divmod(batch_id, MERGE_AFTER)
        if inside or not run:
            return
        begin = (run - 1) * MERGE_AFTER
        self.write(self.merge(self.read(spark, "batch", begin, batch_id)), f"run={run - 1}")
        for name in partitions(spark, self.path, "batch"):
            if int(name) < begin:
                delete(spark, f"{self.path}/batch={name}")


def neighbours(new: DataFrame, history: DataFrame, edges: DataFrame) -> DataFrame:
    """``new`` and all samples that can be next to one of its rows, with ``new`` boolean.

    On a day of a series that ``new`` touches these are all its samples, on its other days the first and
    the last one. So nothing lies between a new row and the row before or after it in the result.
    """
    touched = new.select(*SERIES, "day").distinct()
    near = history.join(touched, [*SERIES, "day"], "left_semi").select(*VALUE, "batch")
    other = outer_edges(edges.join(new.select(*SERIES).distinct(), SERIES, "left_semi"))
    ends = other.join(touched, [*SERIES, "day"], "left_anti").select(
        *SERIES, F.explode(F.array_distinct(F.array("first", "last"))).alias("end")
    )
    far = ends.select(*SERIES, "end.time", "end.value", "end.batch")
    both = near.unionByName(far).withColumn("new", F.lit(False))
    rows = both.unionByName(new.select(*VALUE, "batch").withColumn("new", F.lit(True)))
    return rows.groupBy(*SAMPLE_KEY).agg(
        F.max_by("value", F.struct("new", "batch")).alias("value"), F.max("new").alias("new")
    )


def changed_rates(points: DataFrame, max_series_rows: int) -> DataFrame:
    """Rates of new rows, and those of the rows that now follow a new one."""
    found = counters.rate(points, max_series_rows)
    before = points.filter("new").select(*SERIES, F.col("time").alias("prev_time"), F.lit(True).alias("follows"))
    return found.join(before, [*SERIES, "prev_time"], "left").filter(F.col("new") | F.col("follows")).select(
        *RATES.names
    )


def current_rates(spark: SparkSession, path: str) -> DataFrame:
    """The rate of every sample, as last corrected."""
    if not exists(spark, path):
        return spark.createDataFrame([], RATES)
    schema = StructType([*RATES.fields, StructField("batch", LongType())])
    found = spark.read.schema(schema).parquet(path)
    return found.groupBy("time", *SERIES).agg(F.max_by("rate", "batch").alias("rate")).select(*RATES.names)


def stream_rate(
    samples: DataFrame, path: str, state: str, checkpoint: str,
    max_series_rows: int = 5_000_000, available_now: bool = False, every: str = "5 seconds",
) -> StreamingQuery:
    """Write the rates that every micro-batch changes below ``path``, one folder per batch.

    Samples may come in any order: a late one gets the rate since the sample before it, and the sample
    after it a corrected one. :func:`current_rates` holds the last of each, which is what the batch
    ``rate`` gives over all samples. A sample that comes again replaces the value of the earlier batch;
    of equal series and time within a batch the largest value counts. Samples without time or series
    are left out.

    ``state`` keeps all samples by day, and the first and last one per series and day. A batch reads the
    days that it touches, and for their other days the ends of its own series. A retried batch
    sees the state before it and replaces its own folders, so nothing counts twice. ``checkpoint``,
    ``state`` and ``path`` belong together: batches are known by their number.
    """
    held = _Held(f"{state}/samples", HELD, newest_values)
    ends = _Held(f"{state}/edges", EDGES, outer_edges)

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for kept in (held, ends):
            kept.tidy(spark, batch_id)
        with scratch(spark) as keep:
            rows = batch.dropna(subset=SAMPLE_KEY).groupBy(*SAMPLE_KEY).agg(F.max("value").alias("value"))
            rows = rows.withColumn("batch", F.lit(batch_id).cast("long")).withColumn("day", utc_day("time"))
            new = keep(rows.select(*HELD.names), "batch")
            days = [row.day for row in new.select("day").distinct().collect()]
            near = newest_values(held.before(spark, batch_id, days))
            points = keep(neighbours(new, near, ends.before(spark, batch_id)), "points")
            changed_rates(points, max_series_rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            held.write(new, f"batch={batch_id}")
            ends.write(day_edges(new), f"batch={batch_id}")

    return start(samples.writeStream.foreachBatch(advance), checkpoint, available_now, every)
