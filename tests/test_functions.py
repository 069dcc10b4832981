from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import T0
from seriesframe.functions import labels, times


@pytest.mark.parametrize("text, seconds", [
    ("30s", 30), ("5m", 300), ("1h", 3600), ("1d", 86400), ("7d", 604800), ("", None), (None, None),
])
def test_interval(text, seconds):
    assert times.parse_interval(text) == seconds


@pytest.mark.parametrize("text", ["invalid", "5", "m5", "1hour", "0m", "-5m", "5m\n", "5 m", "٥m"])
def test_bad_interval(text):
    with pytest.raises(ValueError):
        times.parse_interval(text)


@pytest.mark.parametrize("width", [1, 300, 3600, 7 * 3600, 86400, 7 * 86400, 30 * 86400])
def test_time_bucket_origin(spark, width):
    """Buckets are whole widths away from Monday 2000-01-03, also before it."""
    origin = datetime(2000, 1, 3, tzinfo=timezone.utc)
    moments = [
        origin, origin + timedelta(seconds=width) - timedelta(microseconds=1), T0,
        T0 + timedelta(hours=13, microseconds=7), origin - timedelta(microseconds=1),
    ]
    rows = spark.createDataFrame([(m,) for m in moments], "time timestamp")
    got = rows.select(
        F.unix_micros("time").alias("t"), F.unix_micros(times.time_bucket("time", width)).alias("b"),
        F.unix_micros(F.window("time", f"{width} seconds", f"{width} seconds",
                               f"{times.bucket_offset(width)} seconds").start).alias("w"),
    ).collect()
    base = 10_959 * 86_400 * 1_000_000
    for row in got:
        expected = base + (row.t - base) // (width * 1_000_000) * width * 1_000_000
        assert row.b == expected == row.w
    for moment in moments:
        start = times.bucket_start(moment, width)
        assert start <= moment < start + timedelta(seconds=width)
        assert (start - origin) % timedelta(seconds=width) == timedelta(0)


@pytest.mark.parametrize("text, good", [
    ("2024-01-09T12:00:00Z", True), ("2024-01-09T12:00:00.123456Z", True),
    ("2024-01-09T12:00:00+02:00", True), (" 2024-01-09T12:00:00Z ", True),
    ("2024-01-09", False), ("yesterday", False), ("", False), ("2024-13-09T12:00:00Z", False),
    ("1704801600", False), ("2024-01-09T12:00:00", False),
])
def test_parse_iso(spark, text, good):
    row = spark.createDataFrame([(text,)], "t string").select(times.parse_iso("t").alias("p")).first()
    assert (row.p is not None) == good


def test_utc_takes_naive_as_utc():
    assert times.utc("2024-01-01 00:00:00") == T0 == times.utc("2024-01-01T02:00:00+02:00")
    with pytest.raises(ValueError, match="not an ISO"):
        times.utc("soon")


def test_tiers(spark):
    ages = spark.createDataFrame([(9.9,), (10.0,), (29.9,), (30.0,)], "age double")
    as_of = "2024-03-01"
    moment = F.timestamp_micros((F.unix_micros(times.ts_lit(as_of)) - F.col("age") * 86_400e6).cast("long"))
    got = [r[0] for r in ages.select(times.tier(moment, as_of)).collect()]
    assert got == ["hot", "warm", "warm", "cold"]


def test_canonical_key_ignores_order_and_nulls(spark):
    row = spark.sql("""SELECT map('b','2','a','1') x, map('a','1','b','2') y,
                       CAST(NULL AS map<string,string>) n, map('k','say "hi"\\\\') q""")
    got = row.select(*[labels.canonical_key(c).alias(c) for c in "xynq"]).first()
    assert got.x == got.y == '{"a":"1","b":"2"}'
    assert got.n == "{}"
    back = row.select(labels.from_key(labels.canonical_key("q")).alias("q")).first().q
    assert back == {"k": 'say "hi"\\'}


def test_containment(spark):
    rows = spark.sql("SELECT map('a','1','b','2') labels UNION ALL SELECT map('a','1') UNION ALL SELECT map()")
    assert rows.filter(labels.contains("labels", {"a": "1"})).count() == 2
    assert rows.filter(labels.contains("labels", {"b": "2", "a": "1"})).count() == 1
    assert rows.filter(labels.contains("labels", {})).count() == 3


@pytest.mark.parametrize("key, high", [
    *[(k, False) for k in ("zone", "queue", "colour", "rack_no", "")],
    *[(f"x_{word.upper()}9", True) for word in labels.HIGH_CARDINALITY_WORDS],
    ("width", True), ("DESCRIPTION", True),
])
def test_high_cardinality(spark, key, high):
    """Substring semantics: width holds id, description holds ip."""
    assert spark.range(1).select(labels.is_high_cardinality(F.lit(key))).first()[0] is high


def test_prometheus_escapes(spark):
    row = spark.range(1).select(
        labels.prometheus_labels(F.create_map(F.lit("b"), F.lit('x"y\\z\n'), F.lit("a"), F.lit("1"))),
        labels.prometheus_labels(F.create_map().cast("map<string,string>")),
    ).first()
    assert row[0] == '{a="1",b="x\\"y\\\\z\\n"}'
    assert row[1] == ""
