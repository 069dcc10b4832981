"""Posting bitmaps against a look at every label set."""

from __future__ import annotations

import json
import random
from datetime import date, timedelta

import pytest

from seriesframe.operators import postings

SCHEMA = "metric_id string, day date, labels_key string"


@pytest.mark.parametrize("seed", range(3))
def test_days_with_labels(spark, seed):
    rng = random.Random(seed)
    begin = rng.choice([date(1969, 12, 20), date(2024, 1, 1), date(1900, 1, 1)])
    rows = [(rng.choice("ab"), begin + timedelta(days=rng.choice([rng.randint(0, 90), rng.randint(0, 60_000)])),
             json.dumps({k: rng.choice("xyz") for k in rng.sample(["k", "l", "m"], rng.randint(0, 3))}, separators=(",", ":")))
            for _ in range(400)]
    half = len(rows) // 2
    one, two = (postings.label_postings(spark.createDataFrame(part, SCHEMA)) for part in (rows[:half], rows[half:]))
    table = postings.merge_postings(one, two)
    unknown = ("b", begin - timedelta(days=1))
    pairs = sorted({(m, d) for m, d, _ in rows} | {unknown})
    files = spark.createDataFrame([(m, d, f"{m}{d}") for m, d in pairs], "metric_id string, day date, path string")
    for labels in ({}, None, {"k": "x"}, {"k": "x", "l": "y"}, {"k": "none"}, {"k": "x", "l": "y", "m": "z"}):
        want = []
        for m, d in pairs:
            held = {p for m2, d2, key in rows if (m2, d2) == (m, d) for p in json.loads(key).items()}
            if (m, d) == unknown or set((labels or {}).items()) <= held:
                want.append(f"{m}{d}")
        assert sorted(r.path for r in postings.days_with(files, table, labels).collect()) == sorted(want), labels


def test_read_opens_only_matching_files(spark):
    from queries import storing, views

    store = storing._sparse_label(spark, "/root/testdata/sf0.001")
    every = store.read_archive("view", views.START, views.AS_OF)
    some = store.read_archive("view", views.START, views.AS_OF, {"shard": "3"})
    opened = {f for f in every.inputFiles()}, {f for f in some.inputFiles()}
    assert opened[1] < opened[0]
    days = {r.day for r in every.filter("labels.shard = '3'").select("day").distinct().collect()}
    assert {f.split("/day=")[1][:10] for f in opened[1]} == {d.isoformat() for d in days}
    assert some.count() == every.filter("labels.shard = '3'").count()
