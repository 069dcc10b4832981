from __future__ import annotations

import random

import pytest

from helpers import at, samples, tuples
from seriesframe.operators import counters

BIG = 10**9


def brute_rate(rows):
    """(metric, label, seconds) -> rate, sample by sample."""
    out, last = {}, {}
    for seconds, metric, value, labels in sorted(rows, key=lambda r: r[0]):
        key = (metric, tuple(sorted(labels.items())))
        if key in last:
            before, since = last[key]
            out[(metric, tuple(sorted(labels.items())), seconds)] = (
                value if value < before else value - before
            ) / (seconds - since)
        last[key] = (value, seconds)
    return out


def make_rows():
    rng = random.Random(3)
    rows = []
    # A hot series with most rows squeezed into one second, the rest over ten days.
    moments = {round(rng.uniform(100, 101), 4) for _ in range(400)} | {
        float(rng.randrange(0, 10 * 86_400)) for _ in range(120)
    }
    value = 0.0
    for moment in sorted(moments):
        value = 0.0 if rng.random() < 0.05 else value + rng.randrange(0, 9)
        rows.append((moment, "hot", value, {"s": "a"}))
    for moment in range(0, 5000, 250):
        rows.append((float(moment), "cold", float(moment % 1500), {"s": "b"}))
        rows.append((float(moment), "cold", float(moment), {"s": "c", "r": "1"}))
    rows.append((7.0, "once", 1.0, {}))
    return rows


@pytest.mark.parametrize("limit", [BIG, 100, 7, 1])
def test_rate_is_the_same_however_series_are_cut(spark, limit):
    rows = make_rows()
    found = counters.rate(samples(spark, rows).repartition(6), limit)
    got = {(r.metric_id, tuple(sorted(r.labels.items())), r.time): r.rate for r in found.collect()}
    want = {(m, la, at(s)): rate for (m, la, s), rate in brute_rate(rows).items()}
    want = {(m, la, t.replace(tzinfo=None)): rate for (m, la, t), rate in want.items()}
    assert set(got) == set(want)
    for key, rate in want.items():
        assert got[key] == pytest.approx(rate, rel=1e-9)


def test_first_sample(spark):
    rows = [(0, "m", 100, {}), (300, "m", 150, {}), (600, "m", 20, {})]
    df = samples(spark, rows)
    assert tuples(counters.rate(df, BIG), "rate") == [(20 / 300,), (50 / 300,)]
    assert tuples(counters.rate(df, BIG, include_first=True), "rate") == [(0.0,), (20 / 300,), (50 / 300,)]


def test_increase(spark):
    rows = [(0, "m", 100, {"a": "1"}), (1, "m", 5, {"a": "1"}), (2, "m", 200, {"a": "1"}),
            (0, "m", 100, {"a": "2"}), (2, "m", 30, {"a": "2"}), (0, "m", 7, {"a": "3"})]
    got = tuples(counters.counter_increase(samples(spark, rows)),
                 "labels_key", "total_increase", "start_value", "end_value")
    assert got == [('{"a":"1"}', 100.0, 100.0, 200.0), ('{"a":"2"}', 30.0, 100.0, 30.0),
                   ('{"a":"3"}', 0.0, 7.0, 7.0)]


def test_equal_times_do_not_divide_by_zero(spark):
    rows = [(0, "m", 1, {}), (0, "m", 2, {})]
    assert tuples(counters.rate(samples(spark, rows), BIG), "rate") == [(None,)]
