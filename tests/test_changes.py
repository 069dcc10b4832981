"""Incremental rollup refresh and quota admission against recomputation."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesframe.config import CardinalityLimits
from seriesframe.operators import cardinality, changes, rollups
from seriesframe.session import materialize

BEGIN = datetime(2024, 3, 1)
SCHEMA = "metric_id string, labels_key string, time timestamp, value double"


def frame(spark, rows):
    df = spark.createDataFrame([(m, s, BEGIN + timedelta(minutes=t), x) for (m, s, t), x in rows.items()], SCHEMA)
    return df.withColumn("day", F.to_date("time"))


def cells(df):
    return sorted((r.bucket, r.metric_id, r.labels_key, round(r.sum_value, 6), r.min_value, r.max_value, r.sample_count)
                  for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("grain", ["5m", "1h", "1d"])
def test_refresh_equals_recomputation(spark, seed, grain):
    rng = random.Random(seed)

    def key():
        return rng.choice("ab"), rng.choice("xyz"), rng.randint(0, 3000)

    stored = {key(): float(rng.randint(0, 9)) for _ in range(200)}
    fixes = {k: rng.choice([None, stored[k], 0.0, 9.0, 4.0, 20.0]) for k in rng.sample(sorted(stored), 60)}
    fixes |= {key(): float(rng.randint(-3, 12)) for _ in range(40)}
    fixes |= {("c", "new", 77): 1.5}
    if seed == 0:
        fixes |= {k: None for k in stored if k[0] == "a"}  # cells that vanish
    after = {k: x for k, x in {**stored, **fixes}.items() if x is not None}
    before, new = frame(spark, stored), frame(spark, after)
    table = rollups.rollup(before, grain)
    found = changes.sample_changes(before, frame(spark, fixes))
    assert found.count() == sum(stored.get(k) != x for k, x in fixes.items())
    deltas = materialize(changes.bucket_deltas(found, grain), "deltas")
    assert cells(changes.refresh(table, deltas, new, grain)) == cells(rollups.rollup(new, grain))
    # Only cells that lost an extreme are read again.
    lost = {(r.bucket, r.metric_id, r.labels_key) for r in changes.lost_extremes(table, deltas).collect()}
    assert lost <= {(r.bucket, r.metric_id, r.labels_key) for r in deltas.filter("gone_min IS NOT NULL").collect()}


def test_changes_without_lost_extremes_read_no_samples(spark):
    stored = {("a", "x", t): float(t % 7) for t in range(500)}
    fixes = {("a", "x", t): 3.5 for t in range(0, 500, 10) if t % 7 not in (0, 6)}
    before = frame(spark, stored)
    table = rollups.rollup(before, "1h")
    deltas = changes.bucket_deltas(changes.sample_changes(before, frame(spark, fixes)), "1h")
    assert changes.lost_extremes(table, deltas).isEmpty()
    assert cells(changes.refresh(table, deltas, before.limit(0), "1h")) == cells(
        rollups.rollup(frame(spark, {**stored, **fixes}), "1h"))


def test_intervals_join_neighbouring_buckets(spark):
    minutes = [0, 3, 5, 12, 25, 26, 1435, 1440]
    fixes = {("a", s, t): 1.0 for t in minutes for s in "xy"}
    deltas = changes.bucket_deltas(changes.sample_changes(frame(spark, {("b", "x", 0): 1.0}), frame(spark, fixes)), "5m")
    made = sorted((r.begin, r.end, r.buckets) for r in changes.changed_intervals(deltas, "5m").collect())
    at = lambda m: BEGIN + timedelta(minutes=m)
    assert made == [(at(0), at(15), 3), (at(25), at(30), 1), (at(1435), at(1440), 1), (at(1440), at(1445), 1)]


def test_empty_change(spark):
    before = frame(spark, {("a", "x", 1): 2.0})
    deltas = changes.bucket_deltas(changes.sample_changes(before, before), "1h")
    assert deltas.isEmpty() and changes.changed_intervals(deltas, "1h").isEmpty()
    assert cells(changes.refresh(rollups.rollup(before, "1h"), deltas, before, "1h")) == cells(rollups.rollup(before, "1h"))


@pytest.mark.parametrize("seed", range(3))
def test_quota_admits_the_first_arrivals(spark, seed):
    rng = random.Random(seed)
    known = {(m, f"k{n}") for m in "abc" for n in range(rng.randint(0, 8))}
    stored = spark.createDataFrame([(m, s, BEGIN) for m, s in known], "metric_id string, labels_key string, time timestamp")
    rows = [(i, rng.choice("abcd"), rng.choice("kn") + str(rng.randint(0, 30)), rng.random() < 0.8) for i in range(400)]
    rng.shuffle(rows)
    incoming = spark.createDataFrame(rows, "idx long, metric_id string, labels_key string, good boolean").repartition(6)
    limits = CardinalityLimits(max_series_per_metric=12, at_limit="quota")
    marked = cardinality.mark_series_limit(incoming, stored, BEGIN + timedelta(hours=1), limits, eligible=F.col("good"))
    admitted, current = set(known), defaultdict(int)
    for m, _ in known:
        current[m] += 1
    for _, m, s, good in sorted(rows):
        if good and (m, s) not in admitted and current[m] < 12:
            admitted.add((m, s))
            current[m] += 1
    want = sorted((i, good and (m, s) not in admitted, current[m]) for i, m, s, good in rows)
    assert sorted((r.idx, r.over_limit, r.series) for r in marked.collect()) == want
    assert all(n <= 12 for n in current.values())
