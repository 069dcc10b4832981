"""Answers from rollups of several grains: the coarsest inside a range, finer ones towards its edges."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.functions.times import bucket_start, time_bucket, ts_lit, utc
from seriesframe.operators.rollups import GRAINS, merge_over_labels

RAW = "raw"
_TICK = timedelta(microseconds=1)
_DAY = timedelta(days=1)
_PARTS = ["bucket", "sum_value", "min_value", "max_value", "sample_count"]


@dataclass(frozen=True)
class Piece:
    """Times ``begin <= t < end`` that one grain answers; ``raw`` means the samples."""

    grain: str
    begin: datetime
    end: datetime


def fitting_grains(width_seconds: int | None) -> list[str]:
    """Grains whose buckets tile buckets of this width, coarsest first; None fits all."""
    found = [g for g in GRAINS.values() if width_seconds is None or width_seconds % g.seconds == 0]
    return [g.name for g in sorted(found, key=lambda g: -g.seconds)]


def range_cover(
    start, end, grains: Iterable[str], valid_days: Mapping[str, Iterable[date]] | None = None,
    fresh_until=None, rows_per_day: Mapping[str, float] | None = None, scan_rows: int = 100_000,
) -> list[Piece]:
    """Disjoint pieces that make up ``start <= t <= end``, by begin.

    Each grain, coarsest first, takes its whole buckets on the days it is valid for (None: all)
    before ``fresh_until``; what is left goes to the next one, and at last to the samples. With
    ``rows_per_day`` (estimates per grain and ``raw``) a grain is left out where it saves fewer
    rows than the scan of one more table costs (``scan_rows``).
    """
    left = [(utc(start), utc(end) + _TICK)]
    pieces = []
    for name in sorted(grains, key=lambda g: -GRAINS[g].seconds):
        days = None if valid_days is None else set(valid_days.get(name, ()))
        taken, rest = [], []
        for begin, until in left:
            runs = _whole(begin, until, GRAINS[name].seconds, days, fresh_until)
            taken += runs
            edges = [begin, *[edge for run in runs for edge in run], until]
            rest += [(low, high) for low, high in zip(edges[::2], edges[1::2]) if low < high]
        if rows_per_day and _saved(taken, name, rows_per_day) < scan_rows:
            continue
        pieces += [Piece(name, *run) for run in taken]
        left = rest
    pieces += [Piece(RAW, *run) for run in left]
    return sorted(pieces, key=lambda piece: piece.begin)


def _whole(begin: datetime, until: datetime, seconds: int, days: set[date] | None, fresh_until) -> list[tuple]:
    """The runs of whole buckets of an interval on these days; midnight starts a bucket of every grain."""
    first = bucket_start(begin, seconds)
    first = first if first == begin else first + timedelta(seconds=seconds)
    last = bucket_start(until if fresh_until is None else min(until, utc(fresh_until)), seconds)
    if first >= last:
        return []
    if days is None:
        return [(first, last)]
    runs: list[tuple] = []
    for day in sorted(d for d in days if first.date() <= d <= last.date()):
        low = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
        low, high = max(first, low), min(last, low + _DAY)
        if low >= high:
            continue
        if runs and runs[-1][1] == low:
            runs[-1] = (runs[-1][0], high)
        else:
            runs.append((low, high))
    return runs


def _saved(runs: list[tuple], grain: str, rows_per_day: Mapping[str, float]) -> float:
    length = sum((high - low for low, high in runs), timedelta()) / _DAY
    return length * (rows_per_day[RAW] - rows_per_day.get(grain, rows_per_day[RAW]))


def estimate_rows(rollup_tables: Mapping[str, DataFrame]) -> dict[str, float]:
    """Rows a day of every grain and of the samples, from the rollups alone; empty if they are."""
    made = None
    for name, table in rollup_tables.items():
        one = table.agg(
            F.lit(name).alias("grain"), F.count("*").alias("rows"), F.sum("sample_count").alias("samples"),
            (F.datediff(F.max("bucket"), F.min("bucket")) + 1).alias("days"),
        )
        made = one if made is None else made.unionByName(one)
    found = {row["grain"]: row for row in made.filter("rows > 0").collect()}  # one row per grain
    rates = {name: row["rows"] / row["days"] for name, row in found.items()}
    return rates | {RAW: max(row["samples"] / row["days"] for row in found.values())} if found else {}


def finer_rows(rates: Mapping[str, float]) -> dict[str, float]:
    """Estimates completed: a grain has at most one row per series and bucket, and no more than the samples."""
    if not rates:
        return {}
    day = GRAINS["1d"].seconds
    return {g.name: min(rates[RAW], rates["1d"] * day / g.seconds) for g in GRAINS.values()} | dict(rates)


def _in_pieces(table: DataFrame, pieces: list[Piece], column: str) -> DataFrame:
    """Rows of these intervals; a table with a day column is pruned by it."""

    def within(piece: Piece) -> Column:
        inside = (F.col(column) >= ts_lit(piece.begin)) & (F.col(column) < ts_lit(piece.end))
        if "day" in table.columns:
            last = (piece.end - _TICK).date()
            inside = inside & F.col("day").between(F.lit(piece.begin.date()), F.lit(last))
        return inside

    wanted = F.lit(False)
    for piece in pieces:
        wanted = wanted | within(piece)
    return table.filter(wanted)


def covered_parts(samples: DataFrame | None, rollup_tables: Mapping[str, DataFrame], pieces: list[Piece]) -> DataFrame:
    """Partial aggregates of a cover: one scan per grain it names, none of the others.

    All tables hold one metric, already filtered by labels; ``samples`` may be missing where no piece is raw.
    """
    named = {piece.grain for piece in pieces}
    made = None
    for grain in sorted(named - {RAW}):
        mine = [piece for piece in pieces if piece.grain == grain]
        rows = _in_pieces(rollup_tables[grain], mine, "bucket").select(*_PARTS)
        made = rows if made is None else made.unionByName(rows)
    if RAW in named:
        finest = min(grain.seconds for grain in GRAINS.values())
        rest = _in_pieces(samples, [piece for piece in pieces if piece.grain == RAW], "time")
        rows = rest.groupBy(time_bucket("time", finest).alias("bucket")).agg(
            F.sum("value").alias("sum_value"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.count("value").alias("sample_count"),
        )
        made = rows if made is None else made.unionByName(rows)
    return made


def covered_buckets(
    samples: DataFrame | None, rollup_tables: Mapping[str, DataFrame], pieces: list[Piece], width_seconds: int
) -> DataFrame:
    """Bucket statistics over a cover, equal to those from the samples."""
    if width_seconds % min(grain.seconds for grain in GRAINS.values()):
        raise ValueError("buckets of this width are not made of rollup buckets")
    return merge_over_labels(covered_parts(samples, rollup_tables, pieces), width_seconds)


def covered_total(
    samples: DataFrame | None, rollup_tables: Mapping[str, DataFrame], pieces: list[Piece], start
) -> DataFrame:
    """Statistics of the whole range as one row at its start; no row when it is empty."""
    made = covered_parts(samples, rollup_tables, pieces).agg(
        F.sum("sum_value").alias("sum_value"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.sum("sample_count").alias("sample_count"),
    )
    average = (F.col("sum_value") / F.col("sample_count")).alias("avg_value")
    return made.filter("sample_count > 0").select(ts_lit(start).alias("bucket"), average, *_PARTS[1:])
