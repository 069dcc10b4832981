"""Exact percentiles over stored KLL sketches: one sketch per group and time bucket brackets the ranks.

Sizes and brackets come from the sketches, so no samples are read to find them. A bucket that lies
below a bracket as a whole is counted by its size, one above it is left out, both unread; only buckets
that straddle a bracket are scanned, once, and only the slice between its bounds is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.times import time_bucket
from seriesframe.operators.percentiles import HIGHEST, LOWEST, brackets, solve, tally
from seriesframe.session import materialize

K = 800  # about 14 KB a sketch at most, rank error about 0.4 %
MARGIN = 0.01
INFINITE = float("inf")


def value_sketches(
    samples: DataFrame, width_seconds: int, keys: Sequence[str] = ("metric_id",), k: int = K
) -> DataFrame:
    """``bucket, keys, n, low, high, sketch`` of the values that are not NULL.

    NaN is the largest value, as in Spark's order. A sketch cannot hold it and takes it as infinite.
    """
    value = F.when(F.isnan("value"), F.lit(INFINITE)).otherwise(F.col("value"))
    return samples.groupBy(time_bucket("time", width_seconds).alias("bucket"), *keys).agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"),
    )


def replace_sketches(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("metric_id",)) -> DataFrame:
    """Stored sketches with those of buckets that were sketched anew.

    A sketch counts a value as often as it sees it, so a bucket whose samples have changed is
    sketched again from all of them and not added to.
    """
    return stored.join(fresh, ["bucket", *keys], "left_anti").unionByName(fresh)


def sketch_targets(sketches: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Brackets and ranks per group and fraction; no samples are read."""
    edges = [min(max(f + d, 0.0), 1.0) for f in fractions for d in (-MARGIN, MARGIN)]
    merged = sketches.filter("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    points = F.array(*(F.lit(e) for e in edges))
    groups = merged.withColumn("q", F.kll_sketch_get_quantile_double("sketch", points))
    small = F.col("n") <= K  # neighbouring ranks are further apart than the margin

    def edge(j: int) -> Column:
        found = F.col("q")[j]
        if j % 2 == 0:
            return F.when(small, F.lit(LOWEST)).otherwise(found)
        return F.when(small | (found == F.lit(INFINITE)), F.lit(HIGHEST)).otherwise(found)

    return brackets(groups, list(keys), fractions, MARGIN, edge)


def straddled(sketches: DataFrame, targets: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(buckets to be scanned per bracket, ``keys, i, v, c`` of the buckets that lie below it)."""
    pairs = sketches.filter("n > 0").drop("sketch").join(targets, list(keys))
    below, above = F.col("high") < F.col("lo"), F.col("low") > F.col("hi")
    counted = pairs.filter(below).groupBy(*keys, "i").agg(F.sum("n").alias("c"))
    opened = pairs.filter(~below & ~above).select("bucket", *keys, "i", "lo", "hi")
    return opened, counted.withColumn("v", F.lit(None).cast("double"))


def percentiles_by_sketch(
    samples: DataFrame, sketches: DataFrame, fractions: Sequence[float], width_seconds: int,
    keys: Sequence[str] = ("metric_id",),
) -> DataFrame:
    """``keys, percentiles``: exact, interpolated, of all samples in the buckets of ``sketches``.

    The sketches must be those of the samples as they are (:func:`replace_sketches`); for a range, give
    both filtered to whole buckets, or sketch its edges with :func:`value_sketches`. Groups have keys that
    are not NULL; one without values has no row. A bracket that misses is opened to the whole range.
    """
    keys, on = list(keys), [*keys, "i"]
    targets = materialize(sketch_targets(sketches, keys, fractions), "sketch-targets")

    def counted(wanted: DataFrame) -> DataFrame:
        opened, below = straddled(sketches, wanted, keys)
        rows = samples.filter(F.col("value").isNotNull()).select(
            *keys, time_bucket("time", width_seconds).alias("bucket"), F.col("value").alias("v")
        )
        slices = tally(rows.join(opened, [*keys, "bucket"]), on)
        both = slices.unionByName(below.select(*slices.columns))
        return both.groupBy(*on, "v").agg(F.sum("c").alias("c"))

    return solve(targets, keys, counted)
