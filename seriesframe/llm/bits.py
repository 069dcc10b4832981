"""A broadcast bit table that keeps most rows out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 1 << 17


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash, is among ``ids``, and few others; nothing is shuffled.

    The table holds a bit per hashed id in at most ``_WORDS`` rows (2 MB), whatever the number of
    ids. Join its result with ``ids`` for an exact answer.
    """
    word = F.pmod(key, F.lit(_WORDS))
    place: Column = F.pmod(F.shiftright(key, 17), F.lit(64)).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    table = ids.select(word.alias("word"), mark.alias("mark")).groupBy("word").agg(
        F.bit_or("mark").alias("marks")
    )
    marked = rows.withColumns({"word": word, "mark": mark}).join(F.broadcast(table), "word")
    return marked.filter(F.col("mark").bitwiseAND(F.col("marks")) != 0).select(*rows.columns)
