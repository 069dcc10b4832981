from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import samples
from seriesframe.operators import percentiles, quantiles

FRACTIONS = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
HOUR = 3_600


def shapes():
    rng = random.Random(5)
    return {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(6000)],
        "growing": [float(i) for i in range(6000)],
        "mostly copies": [1.0] * 3000 + [rng.random() for _ in range(2000)],
        "one value": [42.0] * 2000,
        "infinite": [float("inf")] * 1500 + [float("-inf")] * 1500 + [0.5] * 20,
        "small": [3.0, 1.0, 2.0],
        "single": [5.0],
    }


def made(spark, groups):
    return samples(spark, [(60 * i, g, v, {}) for g, values in groups.items() for i, v in enumerate(values)])


def by_sketch(rows, fractions=FRACTIONS, sketches=None):
    table = quantiles.value_sketches(rows, HOUR) if sketches is None else sketches
    found = quantiles.percentiles_by_sketch(rows, table, fractions, HOUR)
    return {r.metric_id: r.percentiles for r in found.collect()}


def test_equal_to_numpy(spark):
    groups = shapes()
    infinite = groups.pop("infinite")
    got = by_sketch(made(spark, groups))
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert got[name] == pytest.approx(list(np.percentile(values, [f * 100 for f in FRACTIONS])), rel=1e-12)
    rows = made(spark, {"infinite": infinite})
    want = percentiles.exact_percentiles(rows, ["metric_id"], "value", [0.25, 0.5, 0.75], 10**9).first().percentiles
    assert list(map(str, by_sketch(rows, [0.25, 0.5, 0.75])["infinite"])) == list(map(str, want))


def test_only_buckets_that_straddle_are_opened(spark):
    rows = made(spark, {"growing": shapes()["growing"]})
    table = quantiles.value_sketches(rows, HOUR).cache()
    targets = quantiles.sketch_targets(table, ["metric_id"], [0.5])
    opened, below = quantiles.straddled(table, targets, ["metric_id"])
    # 100 buckets of 60 values; a bracket of 2 % and the sketch's own error touch a few of them.
    assert table.count() == 100 and 1 <= opened.count() <= 6
    assert 0.45 * 6000 < below.first().c <= 0.5 * 6000


@pytest.mark.parametrize("margin", [-0.2, 0.0])
def test_missed_bracket_is_opened(spark, monkeypatch, margin):
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    groups = {n: shapes()[n] for n in ("spread", "growing")}
    got = by_sketch(made(spark, groups), [0.5, 0.9])
    for name, values in groups.items():
        assert got[name] == pytest.approx(list(np.percentile(values, [50, 90])), rel=1e-12)


def test_nan_null_and_nothing(spark):
    rng = random.Random(9)
    values = [float("nan") if i % 20 == 0 else rng.uniform(0, 9) for i in range(4000)]
    rows = made(spark, {"m": values, "all nan": [float("nan")] * 900})
    want = {
        r.metric_id: r.percentiles
        for r in percentiles.exact_percentiles(rows, ["metric_id"], "value", FRACTIONS, 10**9).collect()
    }
    assert {k: list(map(str, v)) for k, v in by_sketch(rows).items()} == {k: list(map(str, v)) for k, v in want.items()}
    empty = rows.limit(0)
    assert by_sketch(empty) == {}
    nulls = rows.filter("metric_id = 'm'").selectExpr("time", "metric_id", "CAST(NULL AS DOUBLE) AS value")
    assert by_sketch(nulls) == {}


def test_changed_buckets_are_sketched_anew(spark):
    groups = {"spread": shapes()["spread"], "growing": shapes()["growing"]}
    stored = quantiles.value_sketches(made(spark, groups), HOUR).cache()
    groups["spread"][30:90] = [1e7 + i for i in range(60)]
    rows = made(spark, groups)
    touched = rows.filter("metric_id = 'spread' AND time < TIMESTAMP '2024-01-01 02:00:00'")
    table = quantiles.replace_sketches(stored, quantiles.value_sketches(touched, HOUR))
    assert table.count() == stored.count()
    got = by_sketch(rows, [0.5, 0.99, 1.0], table)
    for name, values in groups.items():
        assert got[name] == pytest.approx(list(np.percentile(values, [50, 99, 100])), rel=1e-12)
