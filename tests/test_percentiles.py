from __future__ import annotations

import random

import numpy as np
import pytest

from seriesframe.operators import percentiles

FRACTIONS = [0.0, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def shapes():
    rng = random.Random(7)
    return {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(3000)],
        "one value": [42.0] * 2000,
        "mostly copies": [1.0] * 1500 + [rng.random() for _ in range(500)],
        "two humps": [rng.gauss(0, 1) for _ in range(900)] + [rng.gauss(1e9, 1) for _ in range(901)],
        "small": [3.0, 1.0, 2.0],
        "single": [5.0],
    }


@pytest.mark.parametrize("limit", [10**9, 1000, 1])
def test_equal_to_numpy_at_any_group_limit(spark, limit):
    groups = shapes()
    rows = [(name, float(v)) for name, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.percentiles for r in percentiles.exact_percentiles(
        df, ["g"], "v", FRACTIONS, limit).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert got[name] == pytest.approx(list(np.percentile(values, [f * 100 for f in FRACTIONS])), rel=1e-12)


def test_missed_bracket_is_opened(spark, monkeypatch):
    """A sketch that is off costs time, never correctness."""
    values = shapes()["spread"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    monkeypatch.setattr(percentiles, "MARGIN", -0.2)
    got = percentiles.exact_percentiles(df, [], "v", [0.5, 0.9], 100).first()
    assert got.percentiles == pytest.approx(list(np.percentile(values, [50, 90])))


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "v double")
    assert percentiles.exact_percentiles(df, [], "v", [0.5], 10).first().percentiles is None
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    for limit in (100, 1):
        assert percentiles.exact_percentiles(df, [], "v", [0.5], limit).first().percentiles == [2.0]


@pytest.mark.parametrize("fractions", [[0.5, 0.9999], [0.9999], [0.0, 0.97, 1.0]])
def test_nan_is_the_largest_value_at_every_group_size(spark, fractions):
    rows = [(g, float("nan") if i < 20 else float(i)) for g in "ab" for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = [
        {r.g: [str(p) for p in r.percentiles] for r in percentiles.exact_percentiles(df, ["g"], "v", fractions, most).collect()}
        for most in (100_000, 800)
    ]
    assert found[0] == found[1] and set(found[0]) == {"a", "b"}
    assert all(len(p) == len(fractions) for p in found[0].values())
