"""Covers of time ranges by rollups, and cardinality sketches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import T0, at, samples, tuples
from seriesframe.operators import cardinality, cover, rollups, sketches

DAY = 86_400
DAYS = [(T0 + timedelta(days=n)).date() for n in range(-1, 12)]
moments = st.integers(0, 10 * DAY * 1_000_000).map(lambda us: T0 + timedelta(microseconds=us))
day_sets = st.sets(st.sampled_from(DAYS))


@settings(max_examples=200, deadline=None)
@given(moments, moments, st.fixed_dictionaries({g: day_sets for g in rollups.GRAINS}), st.none() | moments)
def test_cover_is_a_partition(one, two, valid, fresh):
    start, end = min(one, two), max(one, two)
    pieces = cover.range_cover(start, end, rollups.GRAINS, valid, fresh)
    assert pieces[0].begin == start and pieces[-1].end == end + timedelta(microseconds=1)
    assert all(a.end == b.begin for a, b in zip(pieces, pieces[1:])) and all(p.begin < p.end for p in pieces)
    for piece in pieces:
        if piece.grain == cover.RAW:
            continue
        step = rollups.GRAINS[piece.grain].seconds
        for edge in (piece.begin, piece.end):
            assert (edge - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() % step == 0
        day = piece.begin.date()
        while day <= (piece.end - timedelta(microseconds=1)).date():
            assert day in valid[piece.grain]
            day += timedelta(days=1)
        assert fresh is None or piece.end <= fresh


def test_few_pieces_for_a_long_range():
    pieces = cover.range_cover(at(17), at(3000 * DAY + 4000.5), rollups.GRAINS)
    assert [p.grain for p in pieces] == ["raw", "5m", "1h", "1d", "1h", "5m", "raw"]
    whole = cover.range_cover(at(0), at(7 * DAY - 1e-6), rollups.GRAINS)
    assert [p.grain for p in whole] == ["1d"]


def test_grains_that_save_nothing_are_left_out():
    rows = {"raw": 1000.0, "5m": 990.0, "1h": 500.0, "1d": 30.0}
    pieces = cover.range_cover(at(1), at(10 * DAY), rollups.GRAINS, rows_per_day=rows, scan_rows=900)
    assert {p.grain for p in pieces} == {"raw", "1d"}
    small = cover.range_cover(at(1), at(10 * DAY), rollups.GRAINS, rows_per_day=rows, scan_rows=100_000)
    assert [p.grain for p in small] == ["raw"]


@pytest.fixture(scope="module")
def week(spark):
    draw = random.Random(5)
    rows = [(draw.uniform(0, 7 * DAY), "m", draw.gauss(0, 9), {"room": draw.choice("abc")}) for _ in range(800)]
    rows += [(n * DAY, "m", 5, {"room": "a"}) for n in range(8)] + [(n * 3600, "m", -3, {}) for n in range(9)]
    found = samples(spark, rows).cache()
    return found, {g: rollups.rollup(found, g).cache() for g in rollups.GRAINS}


@pytest.mark.parametrize("start, end", [(0, 7 * DAY), (1.5, 6 * DAY + 7201.25), (3 * DAY, 3 * DAY), (500, 900)])
def test_covered_equals_samples(week, start, end):
    found, tables = week
    valid = {"1d": DAYS[:4], "1h": DAYS[2:6], "5m": DAYS[1:]}
    inside = found.filter(F.col("time").between(F.lit(at(start)), F.lit(at(end))))
    for width in (300, 3600, DAY, 7 * DAY):
        pieces = cover.range_cover(at(start), at(end), cover.fitting_grains(width), valid)
        got = cover.covered_buckets(found, tables, pieces, width)
        want = rollups.merge_over_labels(rollups.rollup(inside, "5m"), width)
        assert tuples(got, "bucket", "sample_count", "min_value", "max_value") == tuples(
            want, "bucket", "sample_count", "min_value", "max_value")
    total = cover.covered_total(found, tables, cover.range_cover(at(start), at(end), tables, valid), at(start)).collect()
    want = inside.agg(F.sum("value"), F.count("value"), F.min("value"), F.max("value")).first()
    if not want[1]:
        assert total == []
    else:
        row = total[0]
        assert (row.sum_value, row.sample_count, row.min_value, row.max_value) == pytest.approx(tuple(want))


def test_estimates_come_from_rollups(week):
    found, tables = week
    rates = cover.estimate_rows(tables)
    assert rates["raw"] * 8 == pytest.approx(found.count(), rel=0.2) and rates["1d"] < rates["1h"] <= rates["raw"]
    assert cover.estimate_rows({g: t.limit(0) for g, t in tables.items()}) == {}


def test_width_that_no_rollup_tiles(week):
    found, tables = week
    assert cover.fitting_grains(60) == []
    with pytest.raises(ValueError):
        cover.covered_buckets(found, tables, cover.range_cover(at(0), at(9), []), 60)


def test_sketches_keep_their_bound(spark):
    made = spark.range(120_000).select(
        F.timestamp_micros(F.lit(int(T0.timestamp()) * 1_000_000) + F.col("id") * 1_000_000).alias("time"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("metric_id"),
        F.concat(F.lit("k"), F.col("id") % 30_011).alias("labels_key"), F.lit(1.0).alias("value"),
    )
    table = sketches.hourly_sketches(made)
    assert sketches.fold(table, table).count() == table.count()
    both = cardinality.sliding_cardinality(made).join(
        sketches.sliding_series(sketches.fold(table, table)), ["metric_id", "window_end"], "full")
    flags = both.select(sketches.within_bound(F.col("series"), F.col("exact_series")).alias("ok"), "exact_series").collect()
    assert flags and all(row.ok for row in flags) and max(row.exact_series for row in flags) > 20_000
    state = {r.metric_id: r for r in sketches.utilisation(sketches.recent_series(table, at(120_000)), 20_000, 0.8).collect()}
    assert state["cold"].is_critical and state["cold"].is_warning
    assert sketches.recent_series(table, at(90 * DAY)).count() == 0


def test_sketches_of_nothing_and_null_labels(spark):
    empty = samples(spark, []).limit(0)
    assert sketches.hourly_sketches(empty).count() == 0
    nulls = samples(spark, [(1, "m", 1, {})]).withColumn("labels_key", F.lit(None).cast("string"))
    assert tuples(sketches.recent_series(sketches.hourly_sketches(nulls), at(5)), "metric_id", "series") == [("m", 0)]
