"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.session import materialize


def _ranked(node: Column, turn: int) -> Column:
    """A node behind a hash of the turn, so that the order of nodes is a new one in every turn."""
    return F.struct(F.xxhash64(F.lit(turn), node).alias("rank"), node.alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); a component's label is its smallest node.

    Every turn gives each node the first of itself and its neighbours, in an order that is random
    and new in each turn, and goes on with the edges between what was given. So nodes and edges
    shrink by a share in each turn, and all turns together join a small multiple of the edges. Each
    turn is written to the shared folder; none holds a component in one task, and a label that very
    many nodes have is split by Spark's skewed join.
    """
    rest, steps = materialize(edges.select("a", "b").distinct(), "edges"), []
    while not rest.isEmpty():
        turn = len(steps)
        both = rest.union(rest.select("b", "a"))
        first = both.groupBy("a").agg(F.min(_ranked(F.col("b"), turn)).alias("near"))
        given = F.least(_ranked(F.col("a"), turn), "near")["node"]
        steps.append(materialize(first.select(F.col("a").alias("node"), given.alias("given")), "given"))
        one = steps[-1].select(F.col("node").alias("a"), F.col("given").alias("x"))
        two = steps[-1].select(F.col("node").alias("b"), F.col("given").alias("y"))
        between = rest.join(one, "a").join(two, "b").filter("x <> y")
        rest = materialize(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("a").alias("label"))
    last = steps.pop()
    while steps:
        later = last.select(F.col("node").alias("given"), F.col("given").alias("later"))
        last = steps.pop().join(later, "given", "left").select("node", F.coalesce("later", "given").alias("given"))
    last = materialize(last, "given")
    labels = last.groupBy("given").agg(F.min("node").alias("label"))
    return materialize(last.join(labels, "given").select("node", "label"), "labels")
