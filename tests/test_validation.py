from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import T0, at, incoming, registrations, samples, tuples
from seriesframe.config import CardinalityLimits, Settings
from seriesframe.operators import cardinality, catalog
from seriesframe.plans.ingest import validate_batch

DAY = 86_400
ENV = {"env": "prod"}


@pytest.fixture(scope="module")
def registry(spark):
    wide = [f"l{i}" for i in range(12)]
    return spark.createDataFrame(
        [("id-1", "test_metric", "GAUGE", ["env"]), ("id-2", "wide", "GAUGE", wide),
         ("id-3", "bare", "COUNTER", [])],
        "id string, name string, type string, label_keys array<string>",
    )


def reasons(spark, registry, rows, settings=Settings(), stored=None):
    done = validate_batch(incoming(spark, rows), registry, T0, settings, stored)
    return {r.idx: r.reason for r in done.validated.select("idx", "reason").collect()}


def test_boundaries(spark, registry):
    cases = [
        (("test_metric", 1, 0, ENV), None),
        (("", 1, 0, ENV), "name_blank"), ((" \t ", 1, 0, ENV), "name_blank"),
        ((None, 1, 0, ENV), "name_blank"),
        (("a" * 256, 1, 0, ENV), "name_too_long"), (("a" * 255, 1, 0, {}), None),
        (("123-invalid", 1, 0, ENV), "name_invalid"), (("invalid name", 1, 0, ENV), "name_invalid"),
        (("invalid@metric", 1, 0, ENV), "name_invalid"), (("bare\n", 1, 0, {}), "name_invalid"),
        (("a.b-c_d", 1, 0, {}), None),
        (("bare", float("nan"), 0, {}), "value_not_finite"),
        (("bare", float("inf"), 0, {}), "value_not_finite"),
        (("bare", float("-inf"), 0, {}), "value_not_finite"),
        (("bare", None, 0, {}), "value_not_finite"),
        (("bare", 1, 300, {}), None), (("bare", 1, 300.000001, {}), "timestamp_in_future"),
        (("bare", 1, 600, {}), "timestamp_in_future"),
        (("bare", 1, -365 * DAY, {}), None), (("bare", 1, -365 * DAY - 0.000001, {}), "timestamp_too_old"),
        (("bare", 1, -366 * DAY, {}), "timestamp_too_old"), (("bare", 1, None, None), None),
        (("test_metric", 1, 0, {}), "missing_labels"),
        (("test_metric", 1, 0, {"env": "a", "unregistered_label": "x"}), "extra_labels"),
        (("test_metric", 1, 0, {"other": "x"}), "missing_labels"),
        (("test_metric", 1, 0, {"env": "v" * 100}), None),
        (("test_metric", 1, 0, {"env": "v" * 101}), "label_value_over_limit:env"),
        (("test_metric", 1, 0, {"env": "v" * 500}), "label_value_over_limit:env"),
        (("test_metric", 1, 0, {"env": "v" * 501}), "label_value_too_long"),
        (("test_metric", 1, 0, {"env": "\U0001f600" * 50}), None),
        (("test_metric", 1, 0, {"env": "\U0001f600" * 51}), "label_value_over_limit:env"),
        (("test_metric", 1, 0, {"env": " "}), "label_value_blank"),
        (("test_metric", 1, 0, {"": "x"}), "label_key_blank"),
        (("test_metric", 1, 0, {"k" * 101: "x"}), "label_key_too_long"),
        (("test_metric", 1, 0, {"bad-key": "x"}), "label_key_invalid"),
        (("wide", 1, 0, {f"l{i}": "x" for i in range(12)}), "label_count_over_limit"),
        (("wide", 1, 0, {f"l{i}": "v" * 101 if i == 3 else "x" for i in range(12)}),
         "label_count_over_limit; label_value_over_limit:l3"),
        # Unknown names are registered without labels, so labelled samples do not fit.
        (("fresh", 1, 0, {}), None), (("fresh", 1, 0, ENV), "extra_labels"),
    ]
    rows = [(i, n, x, s, la, None) for i, ((n, x, s, la), _) in enumerate(cases)]
    got = reasons(spark, registry, rows)
    for i, (case, want) in enumerate(cases):
        assert got[i] == want, case


def test_label_count_limit(spark):
    keys = [f"l{i}" for i in range(11)]
    registry = spark.createDataFrame(
        [(str(n), f"m{n}", "GAUGE", keys[:n]) for n in (10, 11)],
        "id string, name string, type string, label_keys array<string>",
    )
    rows = [(n, f"m{n}", 1, 0, {k: "x" for k in keys[:n]}, None) for n in (10, 11)]
    assert reasons(spark, registry, rows) == {10: None, 11: "label_count_over_limit"}


def test_first_bad_label_in_sample_order(spark, registry):
    rows = spark.sql("""
        SELECT 0L idx, map('bad-key', ' ', '', 'x') labels
        UNION ALL SELECT 1L, map('env', ' ', 'bad-key', 'x')
        UNION ALL SELECT 2L, map('', 'x', 'bad-key', 'x')""").selectExpr(
        "idx", "'test_metric' name", "1D value", "CAST(NULL AS timestamp) timestamp", "labels",
        "CAST(NULL AS string) type")
    done = validate_batch(rows, registry, T0)
    assert tuples(done.rejected, "idx", "reason") == [
        (0, "label_key_invalid"), (1, "label_value_blank"), (2, "label_key_blank")]


def test_auto_registration(spark, registry):
    rows = [(0, "fresh", float("nan"), 0, {}, "COUNTER"), (1, "fresh", 1, 0, {"a": "1"}, "SUMMARY"),
            (2, "fresh", 1, 0, {"a": "1"}, None), (3, "fresh", 1, 0, {"b": "1"}, None),
            (4, "bare", 1, 0, {}, None), (5, "plain", 1, 0, {}, None)]
    strict = validate_batch(incoming(spark, rows), registry, T0)
    assert tuples(strict.registrations, "name", "type", "labels") == [
        ("fresh", "SUMMARY", []), ("plain", "GAUGE", [])]
    assert tuples(strict.rejected, "idx") == [(0,), (1,), (2,), (3,)]
    adopt = validate_batch(incoming(spark, rows), registry, T0, Settings(auto_register_labels="adopt"))
    assert tuples(adopt.registrations, "name", "labels") == [("fresh", ["a"]), ("plain", [])]
    assert tuples(adopt.rejected, "idx", "reason") == [(0, "value_not_finite"), (3, "missing_labels")]


def test_summary_and_warnings(spark, registry):
    rows = [(0, "bare", 1, 0, {}, None), (1, "bare", float("nan"), 0, {}, None),
            (2, "bare", 2, 0, {"user_id": "1", "zone": "z"}, None)]
    done = validate_batch(incoming(spark, rows), registry, T0)
    assert {(r.status, r.reason, r.samples) for r in done.summary.collect()} == {
        ("accepted", None, 1), ("rejected", "value_not_finite", 1), ("rejected", "extra_labels", 1)}
    warned = {r.idx: r.warnings for r in done.validated.collect()}
    assert warned[0] == [] and warned[2] == ["high_cardinality_label:user_id"]


@pytest.mark.parametrize("series, warns, full", [
    (7, False, False), (8, False, False), (9, True, False), (10, False, True), (11, False, True),
])
def test_series_limit(spark, series, warns, full):
    """Scaled down from 10 000: warn above 80 %, reject unseen series from 100 % on."""
    stored = samples(spark, [(-60, "id-1", 1, {"env": str(i)}) for i in range(series)]
                     + [(-2 * DAY, "id-1", 1, {"env": "old"}), (-DAY, "id-1", 1, {"env": "edge"})])
    registry = spark.createDataFrame(
        [("id-1", "test_metric", "GAUGE", ["env"])],
        "id string, name string, type string, label_keys array<string>")
    settings = Settings(cardinality=CardinalityLimits(max_series_per_metric=10))
    rows = [(0, "test_metric", 1, 0, {"env": "0"}, None), (1, "test_metric", 1, 0, {"env": "new"}, None)]
    done = validate_batch(incoming(spark, rows), registry, T0, settings, stored).validated.collect()
    got = {r.idx: (r.reason, r.warnings) for r in done}
    assert got[0][0] is None
    assert got[1][0] == ("series_over_limit" if full else None)
    assert ("series_near_limit" in got[0][1]) == warns
    strict = Settings(cardinality=CardinalityLimits(max_series_per_metric=10, at_limit="strict_all"))
    both = reasons(spark, registry, rows, strict, stored)
    assert set(both.values()) == ({"series_over_limit"} if full else {None})
    stats = cardinality.cardinality_stats(stored, T0, settings.cardinality).first()
    assert (stats.current_cardinality, stats.is_warning, stats.is_critical) == (
        series, series > 8, series >= 10)


def test_registration_rules(spark):
    known = spark.createDataFrame([("taken",)], "name string")
    cases = [
        (("ok", "GAUGE", ["a"], 30), None), (("ok", "GAUGE", [], 30), "duplicate"),
        (("taken", "GAUGE", [], 30), "duplicate"), ((" ", "GAUGE", [], 30), "name_blank"),
        (("9x", "GAUGE", [], 30), "name_invalid"), (("t", "TIMER", [], 30), "type_invalid"),
        (("u", None, [], 30), "type_invalid"), (("r0", "GAUGE", [], 0), "retention_too_short"),
        (("r1", "GAUGE", [], 1), None), (("r1825", "GAUGE", [], 1825), None),
        (("r1826", "GAUGE", [], 1826), "retention_too_long"), (("rn", "SUMMARY", None, None), None),
        (("l10", "HISTOGRAM", [f"l{i}" for i in range(10)], 1), None),
        (("l11", "GAUGE", [f"l{i}" for i in range(11)], 1), "too_many_labels"),
        (("lb", "GAUGE", ["a", " "], 1), "label_key_blank"),
        (("ll", "GAUGE", ["k" * 101], 1), "label_key_too_long"),
        (("li", "GAUGE", ["1a"], 1), "label_key_invalid"),
        # An invalid request does not use up its name.
        (("later", "GAUGE", [], 0), "retention_too_short"), (("later", "GAUGE", [], 5), None),
    ]
    rows = [(i, *case) for i, (case, _) in enumerate(cases)]
    checked = catalog.check_registrations(registrations(spark, rows), known)
    got = {r.idx: r.reason for r in checked.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    rows = catalog.new_metric_rows(checked.filter("reason IS NULL"), T0)
    assert rows.filter("name = 'rn'").first().retention_days == 30
    assert rows.select("id").distinct().count() == rows.count()


def test_catalogue(spark):
    metrics = spark.createDataFrame(
        [(str(i), n, t, None, None, 30, a, T0, T0) for i, (n, t, a) in enumerate([
            ("http_requests", "COUNTER", True), ("HTTP.latency", "GAUGE", True),
            ("cpu", "GAUGE", False), ("httpXlatency", "GAUGE", True)])],
        "id string, name string, type string, description string, unit string, retention_days int, "
        "is_active boolean, created_at timestamp, updated_at timestamp")
    keys = spark.createDataFrame([("0", "b"), ("0", "a"), ("0", "a")], "metric_id string, label_key string")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(catalog.search_by_name(metrics, "HTTP")) == ["HTTP.latency", "httpXlatency", "http_requests"]
    assert names(catalog.search_by_name(metrics, "p_l")) == ["HTTP.latency", "httpXlatency"]
    assert names(catalog.filter_by_type(metrics, "GAUGE")) == ["HTTP.latency", "cpu", "httpXlatency"]
    page = catalog.list_metrics(metrics, keys, limit=2, offset=1)
    assert [r.name for r in page.collect()] == ["httpXlatency", "http_requests"]
    assert {r.name: r.label_keys for r in page.collect()}["http_requests"] == ["a", "b"]
    assert names(catalog.list_metrics(metrics, keys, search="cpu", include_inactive=True)) == ["cpu"]
    with pytest.raises(catalog.MetricNotFound):
        catalog.resolve_metric(metrics, "nope")
    with pytest.raises(ValueError):
        catalog.resolve_metric(metrics, "  ")
    with pytest.raises(ValueError):
        catalog.update_metric(metrics, "0", T0, retention_days=1826)
    changed = catalog.update_metric(metrics, "0", at(5), retention_days=7)
    assert changed.filter("id = '0'").first().retention_days == 7
    assert changed.filter(F.col("updated_at") == F.lit(at(5))).count() == 1
    assert catalog.metric_uuid(F.lit("cpu"))is not None
