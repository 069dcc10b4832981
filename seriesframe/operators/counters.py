"""Counter operators: reset-aware rate and increase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesframe.functions.times import seconds_between
from seriesframe.schema import SERIES
from seriesframe.session import materialize

# Fixed steps by which an overlong series is cut, coarse to fine (microseconds).
SLICE_STEPS = [
    86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1,
]


def rate_value(value: Column, before: Column, since: Column, at: Column) -> Column:
    """Per-second increase; a fall in value is a reset, so the new value is the increase."""
    increase = F.when(value < before, value).otherwise(value - before)
    return F.try_divide(increase, seconds_between(since, at))


def with_previous(samples: DataFrame, max_series_rows: int) -> DataFrame:
    """Adds ``prev_time`` and ``prev_value`` of the same series.

    One window task holds one series. A series longer than ``max_series_rows`` is cut into
    calendar slices, finer and finer until no slice is too long, and the last sample of each
    slice is handed on to the next one, so every row still sees its true predecessor.
    """
    slice_of, hot = _slices(samples, max_series_rows)
    if slice_of is None:
        order = Window.partitionBy(*SERIES).orderBy("time")
        return samples.withColumn("prev_time", F.lag("time").over(order)).withColumn(
            "prev_value", F.lag("value").over(order)
        )
    sliced = slice_of(samples)
    last = (
        slice_of(samples.join(hot, SERIES, "left_semi"))
        .groupBy(*SERIES, "slice")
        .agg(F.max_by("value", "time").alias("value"), F.max("time").alias("time"))
    )
    following = F.lead("slice").over(Window.partitionBy(*SERIES).orderBy("slice"))
    handed = (
        last.withColumn("slice", following).filter("slice IS NOT NULL")
        .withColumn("handed", F.lit(True))
    )
    order = Window.partitionBy(*SERIES, "slice").orderBy("time")
    return (
        sliced.withColumn("handed", F.lit(False))
        .unionByName(handed, allowMissingColumns=True)
        .withColumn("prev_time", F.lag("time").over(order))
        .withColumn("prev_value", F.lag("value").over(order))
        .filter(~F.col("handed"))
        .drop("handed", "slice")
    )


def _cell(step: int) -> Column:
    micros = F.unix_micros("time")
    return micros - F.pmod(micros, F.lit(step))


def _longest(samples: DataFrame, keys: list[str]) -> int:
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _cell_sizes(rows: DataFrame, name: str, step: int) -> DataFrame:
    return rows.groupBy(*SERIES, _cell(step).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def _slices(samples: DataFrame, max_rows: int):
    """(function adding ``slice``, hot series), or (None, None) when no series is too long."""
    # A metric that is short enough has no overlong series, and counting it needs no label key.
    if _longest(samples, ["metric_id"]) <= max_rows or _longest(samples, SERIES) <= max_rows:
        return None, None
    # One pass counts (series, day); overlong series and days both follow from it. Each table
    # of hot cells has at most rows / max_rows rows, and Spark picks the join from its size.
    rows = samples.select(*SERIES, "time")
    cells = materialize(_cell_sizes(rows, "cell_1", SLICE_STEPS[0]), "series-days")
    hot = materialize(
        cells.groupBy(*SERIES).agg(F.sum("n").alias("n"))
        .filter(F.col("n") > max_rows).select(*SERIES),
        "hot-series",
    )
    levels = [(None, hot)]
    for step, finer in zip(SLICE_STEPS, SLICE_STEPS[1:]):
        name = f"cell_{len(levels)}"
        heavy = materialize(
            cells.filter(F.col("n") > max_rows).select(*SERIES, name), "hot-cells"
        )
        if heavy.isEmpty():
            break
        levels.append((name, heavy))
        rows = rows.withColumn(name, _cell(step)).join(heavy, [*SERIES, name], "left_semi")
        cells = _cell_sizes(rows, f"cell_{len(levels)}", finer)

    def slice_of(df: DataFrame) -> DataFrame:
        chosen = F.lit(0).cast("long")
        for depth, (name, heavy) in enumerate(levels):
            if name is not None:
                df = df.withColumn(name, _cell(SLICE_STEPS[depth - 1]))
            mark = f"heavy_{depth}"
            df = df.join(heavy.withColumn(mark, F.lit(True)), [*SERIES, *([name] if name else [])], "left")
            chosen = F.when(F.col(mark), _cell(SLICE_STEPS[depth])).otherwise(chosen)
        names = [name for name, _ in levels if name] + [f"heavy_{d}" for d in range(len(levels))]
        return df.withColumn("slice", chosen).drop(*names)

    return slice_of, hot


def rate(samples: DataFrame, max_series_rows: int, include_first: bool = False) -> DataFrame:
    """Adds ``rate`` per sample and series.

    The first sample of a series has no predecessor and is dropped; with ``include_first`` it
    stays with rate 0.
    """
    found = with_previous(samples, max_series_rows).withColumn(
        "rate",
        rate_value(F.col("value"), F.col("prev_value"), F.col("prev_time"), F.col("time")),
    )
    if include_first:
        return found.withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return found.filter(F.col("prev_time").isNotNull())


def newest_points(points: DataFrame, limit: int | None) -> DataFrame:
    """Newest first with a total order, so equal times never make a limit arbitrary."""
    ordered = points.orderBy(F.col("time").desc(), "metric_id", "labels_key")
    return ordered if limit is None else ordered.limit(limit)


def first_last(samples: DataFrame) -> DataFrame:
    """First and last value of each series, as two map-side combined aggregates."""
    return samples.groupBy(*SERIES).agg(
        F.min_by("value", "time").alias("start_value"),
        F.max_by("value", "time").alias("end_value"),
    )


def counter_increase(samples: DataFrame) -> DataFrame:
    """Increase over the range per series; a last value below the first one means a reset."""
    grown = F.col("end_value") >= F.col("start_value")
    increase = F.when(grown, F.col("end_value") - F.col("start_value")).otherwise(
        F.col("end_value")
    )
    return first_last(samples).select(
        *SERIES, increase.alias("total_increase"), "start_value", "end_value"
    )


def rate_from_rollup(rollup: DataFrame) -> DataFrame:
    """Rate between consecutive buckets of a series, read from the bucket maxima.

    Exact for counters without a reset inside a bucket. A series has at most one row per
    bucket of the range, so one window task stays small whatever the sample rate.
    """
    order = Window.partitionBy(*SERIES).orderBy("bucket")
    before = F.lag("max_value").over(order)
    since = F.lag("bucket").over(order)
    return (
        rollup.withColumn("prev_value", before).withColumn("prev_bucket", since)
        .filter(F.col("prev_bucket").isNotNull())
        .select(
            F.col("bucket").alias("time"), *SERIES,
            rate_value(
                F.col("max_value"), F.col("prev_value"), F.col("prev_bucket"), F.col("bucket")
            ).alias("rate"),
        )
    )
