"""Exact interpolated percentiles that no single task has to hold.

A group of at most ``max_group_rows`` values is sorted as one array, which is several times
faster than the value counts of Spark's ``percentile``. A bigger group takes another way:

1. ``percentile_approx`` (a bounded sketch) brackets each wanted rank;
2. values below a bracket collapse to one counted row and values above it are dropped, so only
   a thin slice of the group is shuffled, already counted per distinct value;
3. the counted slice is range-partitioned, which balances whatever the values are. Partition
   totals tell which partition holds the rank, and only that one is ranked.

The sketch only has to be close: a bracket that misses its rank is found by the counts and is
opened to the whole value range, so the answer is always exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesframe.session import materialize

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
SIDE_BY_SIDE = 8
# NaN is the largest value in Spark's order, so it is the open upper end of a bracket.
LOWEST, HIGHEST = float("-inf"), float("nan")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    max_group_rows: int,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """``keys, percentiles array<double>`` plus any ``extra`` aggregates of the same groups.

    ``max_group_rows`` bounds what one task sorts in memory, not what the result covers. NaN counts
    as the largest value, whichever way a group takes.
    """
    keys = list(keys)
    if keys:
        # Spark aggregates up to 128 groups side by side in one task, so each must be smaller.
        max_group_rows = max(1, max_group_rows // SIDE_BY_SIDE)
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= max_group_rows:
        return _sorted_percentiles(df, keys, value, fractions, extra)

    if not keys:
        rows = df.withColumn("whole", F.lit(0))
        ranked = _ranked_percentiles(rows, ["whole"], value, fractions)
        if extra:
            ranked = ranked.join(rows.groupBy("whole").agg(*extra), "whole")
        return ranked.drop("whole")
    # At most rows / max_group_rows groups are hot, and each is one row here.
    hot = materialize(sizes.filter(F.col("n") > max_group_rows).select(*keys), "hot-groups")
    hot_rows = df.join(hot, keys, "left_semi")
    cold = _sorted_percentiles(df.join(hot, keys, "left_anti"), keys, value, fractions, extra)
    ranked = _ranked_percentiles(hot_rows, keys, value, fractions)
    if extra:
        ranked = ranked.join(hot_rows.groupBy(*keys).agg(*extra), keys)
    return cold.unionByName(ranked)


def _sorted_percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: Sequence[float], extra: Sequence[Column]
) -> DataFrame:
    """The way of bounded groups."""
    values = F.sort_array(F.collect_list(value)).alias("sorted")
    made = df.groupBy(*keys).agg(values, *extra)
    last = F.size("sorted") - 1
    points = []
    for fraction in fractions:
        at = F.lit(float(fraction)) * last
        low = F.get("sorted", F.floor(at).cast("int"))
        high = F.get("sorted", F.ceil(at).cast("int"))
        points.append(low + (high - low) * (at - F.floor(at)))
    return made.withColumn("percentiles", F.when(last >= 0, F.array(*points))).drop("sorted")


def _ranked_percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    targets = materialize(_targets(rows, keys, fractions), "percentile-targets")
    return solve(targets, keys, lambda wanted: _counted(rows, keys, wanted))


def solve(targets: DataFrame, keys: list[str], counted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keys, percentiles`` from brackets, which ``counted`` turns into counted slices of values."""
    picked = materialize(_pick(counted(targets), keys, targets), "percentile-picks")
    on = [*keys, "i"]
    # A bracket that missed (a rank has no value) is opened to the whole range.
    missed = targets.join(
        picked.filter(F.col("v0").isNotNull() & F.col("v1").isNotNull()), on, "left_anti"
    )
    if not missed.isEmpty():
        opened = materialize(
            missed.withColumn("lo", F.lit(LOWEST)).withColumn("hi", F.lit(HIGHEST)),
            "percentile-targets",
        )
        again = _pick(counted(opened), keys, opened)
        picked = picked.join(opened, on, "left_anti").unionByName(again)
    value_at = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")
    return (
        picked.join(targets.select(*on, "part"), on)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("i", value_at.alias("p")))).alias("points"))
        .select(*keys, F.transform("points", lambda point: point["p"]).alias("percentiles"))
    )


def _targets(rows: DataFrame, keys: list[str], fractions: Sequence[float]) -> DataFrame:
    """Per group and fraction: bracket [lo, hi], the two ranks and the share between them."""
    edges = [min(max(f + d, 0.0), 1.0) for f in fractions for d in (-MARGIN, MARGIN)]
    sketch = rows.groupBy(*keys).agg(
        F.count("v").alias("n"), F.percentile_approx("v", edges, ACCURACY).alias("q")
    )
    return brackets(sketch, keys, fractions, MARGIN, lambda j: F.col("q")[j])


def brackets(
    groups: DataFrame, keys: list[str], fractions: Sequence[float], margin: float, edge: Callable[[int], Column]
) -> DataFrame:
    """A row per group and fraction from groups with ``n``; ``edge`` gives the lower, then the upper
    value of each fraction's bracket."""
    parts = []
    for i, fraction in enumerate(fractions):
        lo = F.lit(LOWEST) if fraction - margin <= 0 else edge(2 * i)
        hi = F.lit(HIGHEST) if fraction + margin >= 1 else edge(2 * i + 1)
        at = F.lit(float(fraction)) * (F.col("n") - 1)
        parts.append(F.struct(
            F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"),
            F.floor(at).alias("k0"), F.ceil(at).alias("k1"), (at - F.floor(at)).alias("part"),
        ))
    return groups.select(*keys, F.explode(F.array(*parts)).alias("t")).select(*keys, "t.*")


def _counted(rows: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """``keys, i, v, c``: values within the brackets and their number; v NULL: all below a bracket.

    The targets are a few rows per hot group. They are a written table, so Spark knows their size: it
    broadcasts them while that is small and splits the hot groups of a shuffle join beyond. The join
    only tags rows; what is shuffled next is already counted.
    """
    return tally(rows.join(targets, keys), [*keys, "i"])


def tally(tagged: DataFrame, on: list[str]) -> DataFrame:
    """The counts of rows ``v`` tagged with their bracket."""
    return (
        tagged.filter(F.col("v") <= F.col("hi"))
        .groupBy(*on, F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _pick(counted: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """``keys, i, v0, v1``: the values at ranks k0 and k1, NULL where the bracket missed."""
    on = [*keys, "i"]
    # NULL (everything below the bracket) sorts first, so running counts are true ranks.
    placed = materialize(
        counted.repartitionByRange(*on, "v").withColumn("part_id", F.spark_partition_id()),
        "percentile-slice",
    )
    earlier = Window.partitionBy(*on).orderBy("part_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = (
        placed.groupBy(*on, "part_id").agg(F.sum("c").alias("total"))
        .withColumn("base", F.sum("total").over(earlier) - F.col("total"))
    )
    holders = totals.join(targets.select(*on, "k0", "k1"), on).filter(
        ((F.col("k0") >= F.col("base")) & (F.col("k0") < F.col("base") + F.col("total")))
        | ((F.col("k1") >= F.col("base")) & (F.col("k1") < F.col("base") + F.col("total")))
    )
    running = Window.partitionBy(*on, "part_id").orderBy(F.col("v").asc_nulls_first())
    upto = F.col("base") + F.sum("c").over(
        running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = placed.join(holders, [*on, "part_id"]).withColumn("upto", upto)

    def at(rank: str) -> Column:
        inside = (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("c"))
        return F.max(F.when(inside, F.col("v")))

    return ranked.groupBy(*on).agg(at("k0").alias("v0"), at("k1").alias("v1"))
