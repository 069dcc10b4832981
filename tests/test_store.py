from __future__ import annotations

import glob
import json
import os
import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import T0, at, incoming, registrations, samples, tuples
from seriesframe import Aggregation, SeriesStore, QueryRequest, Settings
from seriesframe.config import QueryLimits
from seriesframe.operators import archive, rollups
from seriesframe.operators.catalog import MetricNotFound
from seriesframe.session import scratch_path
from seriesframe.sources import tables
from seriesframe.sources.samples import read_samples_json, read_samples_ndjson
from seriesframe.streaming.ingest import stream_ingest

DAY, HOUR = 86_400, 3_600
KEYS = ["metric_id", "labels_key", "time", "value"]


def copied(spark, template, folder):
    """Stores are plain folders, so tests start from copies of one that was built once."""
    shutil.copytree(template.removeprefix("file:"), folder.removeprefix("file:"))
    return SeriesStore(spark, folder)


@pytest.fixture(scope="module")
def registered(spark):
    made = SeriesStore(spark, scratch_path(spark, "registered"))
    made.register(registrations(spark, [
        (0, "temp", "GAUGE", ["room"], 60), (1, "hits", "COUNTER", ["path"], 5),
    ]), T0)
    return made.root


@pytest.fixture
def store(spark, registered, folder):
    return copied(spark, registered, folder)


def gauge(i, seconds, value, room="a"):
    return (i, "temp", value, seconds, {"room": room}, None)


def values(store, name="temp"):
    metric_id = store.resolve(name)["id"]
    return tuples(store.samples(metric_id), "labels_key", "time", "value")


def test_register_and_update(spark, store):
    again = store.register(registrations(spark, [(0, "temp", "GAUGE", [], 1)]), T0)
    assert again.first().reason == "duplicate"
    metric_id = store.resolve("temp")["id"]
    store.update_metric(metric_id, at(9), retention_days=90)
    store.deactivate_metric(metric_id, at(10))
    row = store.resolve("temp")
    assert (row["retention_days"], row["is_active"]) == (90, False)
    assert [r.name for r in store.list_metrics().collect()] == ["hits"]
    with pytest.raises(MetricNotFound):
        store.update_metric("nope", T0, is_active=True)


def test_ingest_is_visible_merged_and_idempotent(spark, store):
    store.ingest(incoming(spark, [gauge(0, 0, 1), gauge(1, 0, 2), gauge(2, 60, 5)]), at(100), "b1")
    first = values(store)
    assert [v for *_, v in first] == [2.0, 5.0]  # last arrival of the batch wins
    store.ingest(incoming(spark, [gauge(0, 0, 3), gauge(1, 2 * DAY, 7)]), at(2 * DAY), "b2")
    before = values(store)
    assert [v for *_, v in before] == [3.0, 5.0, 7.0]
    store.ingest(incoming(spark, [gauge(0, 0, 3), gauge(1, 2 * DAY, 7)]), at(2 * DAY), "b2")
    assert values(store) == before
    store.merge_incoming()
    assert values(store) == before and store.incoming().isEmpty()
    store.merge_incoming()
    assert values(store) == before
    assert store.ingest_totals().first()["total_accepted"] == 5
    # A later batch beats merged rows, and untouched days keep their files.
    kept = glob.glob(f"{store.path('samples')}/version=*/day=2024-01-03/*.parquet")
    store.ingest(incoming(spark, [gauge(0, 60, 6)]), at(2 * DAY), "b3")
    assert [v for *_, v in values(store)] == [3.0, 6.0, 7.0]
    store.merge_incoming()
    assert [v for *_, v in values(store)] == [3.0, 6.0, 7.0]
    assert kept == glob.glob(f"{store.path('samples')}/version=*/day=2024-01-03/*.parquet") != []


def lost(*args, **options):
    raise OSError("lost")


def failing_commit(monkeypatch, after: int):
    """The change of a table after ``after`` others fails, once its files are written."""
    count, commit = [0], tables.commit

    def commit_or_fail(*args):
        count[0] += 1
        return lost() if count[0] > after else commit(*args)

    monkeypatch.setattr(tables, "commit", commit_or_fail)


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_interrupted_merge_can_be_repeated(spark, store, monkeypatch, after):
    store.ingest(incoming(spark, [gauge(0, 0, 1), gauge(1, DAY, 2)]), at(DAY), "b1")
    failing_commit(monkeypatch, after)
    with pytest.raises(OSError):
        store.merge_incoming()
    monkeypatch.undo()
    assert [v for *_, v in values(store)] == [1.0, 2.0]
    store.merge_incoming()
    assert [v for *_, v in values(store)] == [1.0, 2.0]


def test_repeated_batch_does_not_beat_newer_values(spark, store):
    one, two = (incoming(spark, [gauge(0, 0, v)]) for v in (100, 200))
    store.ingest(one, at(5), "x1")
    store.ingest(two, at(5), "x2")
    store.ingest(one, at(5), "x1")
    assert [v for *_, v in values(store)] == [200.0]
    store.merge_incoming()
    store.ingest(one, at(5), "x1")
    assert [v for *_, v in values(store)] == [200.0]
    store.ingest(incoming(spark, [gauge(0, 0, 300)]), at(5), "x3")
    assert [v for *_, v in values(store)] == [300.0]


def test_failed_catalogue_change_keeps_the_catalogue(spark, store, monkeypatch):
    metric_id = store.resolve("temp")["id"]
    failing_commit(monkeypatch, 0)
    with pytest.raises(OSError):
        store.update_metric(metric_id, at(9), retention_days=90)
    monkeypatch.undo()
    assert store.metrics().count() == 2 and store.resolve("temp")["retention_days"] == 60
    store.update_metric(metric_id, at(9), retention_days=90)
    store.vacuum()
    assert store.resolve("temp")["retention_days"] == 90 and store.metrics().count() == 2


def test_second_writer_is_refused(spark, store, monkeypatch):
    monkeypatch.setattr(tables.files, "write_new", lambda *a: False)
    with pytest.raises(RuntimeError):
        store.deactivate_metric(store.resolve("temp")["id"], at(9))


def test_rejects_and_auto_registration(spark, store):
    rows = [gauge(0, 0, 1), (1, "temp", 1, 0, {}, None), (2, "fresh", 4, 0, {}, "COUNTER")]
    done = store.ingest(incoming(spark, rows), at(5), "b1")
    assert tuples(done.rejected, "idx", "reason") == [(1, "missing_labels")]
    assert store.resolve("fresh")["type"] == "COUNTER"
    assert [v for *_, v in values(store, "fresh")] == [4.0]
    store.ingest(incoming(spark, [(0, "fresh", 5, 1, {}, "GAUGE")]), at(5), "b2")
    assert store.metrics().filter("name = 'fresh'").count() == 1


def test_series_limit_counts_merged_and_waiting(spark, folder):
    from seriesframe.config import CardinalityLimits

    store = SeriesStore(spark, folder, Settings(cardinality=CardinalityLimits(max_series_per_metric=2)))
    store.register(registrations(spark, [(0, "temp", "GAUGE", ["room"], 60)]), T0)
    store.ingest(incoming(spark, [gauge(0, 0, 1, "a")]), at(5), "b1")
    store.merge_incoming()
    store.ingest(incoming(spark, [gauge(0, 1, 1, "b")]), at(5), "b2")
    done = store.ingest(incoming(spark, [gauge(0, 2, 1, "a"), gauge(1, 2, 1, "c")]), at(5), "b3")
    assert tuples(done.rejected, "idx", "reason") == [(1, "series_over_limit")]
    later = store.ingest(incoming(spark, [gauge(0, 2 * DAY, 1, "c")]), at(2 * DAY), "b4")
    assert later.rejected.isEmpty()


@pytest.fixture(scope="module")
def frozen(spark, registered):
    """A filled store with rollups, for tests that only read."""
    store = copied(spark, registered, scratch_path(spark, "filled"))
    rows = []
    for i in range(0, 12 * 24):
        rows.append(gauge(2 * i, i * HOUR + 17, (i * 37) % 101, "ab"[i % 2]))
        rows.append((2 * i + 1, "hits", (i % 50) * 3, i * HOUR + 41, {"path": "/x"}, None))
    store.ingest(incoming(spark, rows), at(12 * DAY), "b1")
    store.merge_incoming()
    store.refresh_rollups()
    return store


@pytest.fixture
def filled(spark, frozen, folder):
    return copied(spark, frozen.root, folder)


def query(store, name="temp", start=0, end=12 * DAY, **options):
    return store.query(QueryRequest(name, at(start), at(end), **options), at(12 * DAY))


def test_query_dispatch(frozen):
    filled = frozen
    raw = query(filled, limit=5).collect()
    assert [r.timestamp for r in raw] == sorted((r.timestamp for r in raw), reverse=True)
    assert len(raw) == 5 and raw[0].labels == {"room": "b"}
    one = query(filled, labels={"room": "a"}, limit=1000)
    assert one.count() == 144
    total = query(filled, aggregation=Aggregation.SUM).first()
    buckets = query(filled, aggregation=Aggregation.SUM, interval="1d").collect()
    assert total.value == sum(b.value for b in buckets) and len(buckets) == 12
    assert total.timestamp.isoformat() == "2024-01-01T00:00:00"
    assert query(filled, aggregation=Aggregation.COUNT, labels={"room": "a"}).first().value == 144.0
    assert query(filled, aggregation=Aggregation.AVG, labels={"room": "zz"}).count() == 0
    assert query(filled, aggregation=Aggregation.P95, labels={"room": "zz"}).first().value == 0.0
    median = query(filled, aggregation=Aggregation.P50).first()
    assert median.timestamp.isoformat() == "2024-01-13T00:00:00"
    assert query(filled, aggregation=Aggregation.P50, interval="1d").count() == 12
    rates = query(filled, "hits", aggregation=Aggregation.RATE, limit=1000)
    assert rates.count() == 12 * 24 - 1
    assert rates.first().labels == {"path": "/x"}
    assert query(filled, start=100 * DAY, end=100 * DAY + 1).count() == 0


def test_query_errors(frozen):
    filled = frozen
    bad = [
        (ValueError, dict(name="temp", aggregation=Aggregation.RATE)),
        (ValueError, dict(name="temp", start=10, end=0)),
        (ValueError, dict(name="temp", start=0, end=91 * DAY)),
        (ValueError, dict(name="temp", interval="1hour", aggregation=Aggregation.AVG)),
        (ValueError, dict(name="temp", limit=0)), (ValueError, dict(name="temp", limit=10_001)),
        (ValueError, dict(name=" ")), (MetricNotFound, dict(name="unknown")),
    ]
    for error, options in bad:
        with pytest.raises(error):
            query(filled, **options)
    assert query(filled, start=0, end=90 * DAY, limit=10_000).count() == 288


def test_default_range_is_a_day(frozen):
    got = frozen.query(QueryRequest("temp", limit=1000), at(12 * DAY))
    assert got.count() == 24


def test_instant_range_statistics(frozen):
    filled = frozen
    point = filled.instant("temp", at(5 * HOUR + 60))
    assert tuples(point, "value") == [((5 * 37) % 101,)]
    assert filled.instant("temp", at(5 * HOUR + 78)).isEmpty()
    assert filled.range_query("temp", at(0), at(DAY), "6h").count() == 4
    stats = filled.statistics("temp", at(12 * DAY), at(0), at(12 * DAY)).first()
    assert stats["count"] == 288 and stats["min"] == 0.0 and stats["max"] == 100.0
    empty = filled.statistics("temp", at(400 * DAY)).first()
    assert (empty["p50"], empty["p95"], empty["p99"], empty["count"], empty["avg"]) == (0.0, 0.0, 0.0, None, None)


def test_bucket_cap(spark, frozen):
    capped = SeriesStore(spark, frozen.root, Settings(query=QueryLimits(max_buckets=3)))
    got = query(capped, aggregation=Aggregation.MAX, interval="1d").collect()
    assert [r.timestamp.day for r in got] == [12, 11, 10]


@pytest.mark.parametrize("aggregation, interval", [
    ("SUM", "5m"), ("AVG", "2h"), ("MIN", "1d"), ("MAX", "7d"), ("COUNT", "1h"),
    ("SUM", None), ("AVG", None),
])
def test_routed_equals_raw(frozen, aggregation, interval):
    filled = frozen
    options = dict(aggregation=Aggregation(aggregation), interval=interval)
    for start, end, labels in [(0, 12 * DAY, {}), (5 * HOUR + 20, 8 * DAY + 17, {"room": "a"}),
                               (HOUR + 18, HOUR + 19, {}), (30, 40, {})]:
        request = QueryRequest("temp", at(start), at(end), labels, **options)
        want = {r.timestamp: r.value for r in filled.query(request, T0).collect()}
        got = {r.timestamp: r.value for r in filled.routed_query(request, T0, scan_rows=0).collect()}
        assert got == pytest.approx(want)
        fresh = filled.routed_query(request, T0, fresh_until=at(3 * DAY + 5), scan_rows=0)
        assert {r.timestamp: r.value for r in fresh.collect()} == pytest.approx(want)


def test_small_ranges_are_answered_by_samples(frozen):
    """Estimates come from the daily rollup; whichever tables are opened, answers are the same."""
    request = QueryRequest("temp", at(5), at(9 * DAY), {}, Aggregation.SUM, "1d")
    assert frozen._rows_per_day("temp")["raw"] == pytest.approx(24, rel=0.1)
    answers = {n: frozen.routed_query(request, T0, scan_rows=n) for n in (0, 100, 1_000_000)}
    opened = {n: " ".join(df.inputFiles()) for n, df in answers.items()}
    assert "rollup_1h" in opened[0] and "rollup_1d" in opened[0]
    assert "rollup_1d" in opened[100] and "rollup_1h" not in opened[100] and "rollup_" not in opened[1_000_000]
    assert len({tuple(tuples(df, "timestamp", "value")) for df in answers.values()}) == 1


def test_rollups_agree(frozen):
    filled = frozen
    for grain in ("5m", "1h", "1d"):
        direct = rollups.rollup(filled.samples(), grain)
        columns = ["bucket", "metric_id", "labels_key", "avg_value", "sum_value", "sample_count"]
        assert tuples(filled.rollup(grain), *columns) == tuples(direct, *columns)
    rates = filled.rate_from_rollup("hits", "1h", at(0), at(DAY - 1))
    raw = filled.counter_rate("hits", at(0), at(DAY))
    assert [r for r, in tuples(rates, "rate")] == pytest.approx([r for r, in tuples(raw, "rate")])


def test_refresh_band_touches_only_its_buckets(spark, filled):
    filled.ingest(incoming(spark, [gauge(0, i * HOUR + 18, 1000) for i in range(240)]), at(10 * DAY), "b2")
    filled.refresh_band("1h", at(10 * DAY - 30 * 60))
    begin, until = rollups.refresh_band("1h", at(10 * DAY - 30 * 60))
    assert (until - begin).total_seconds() == HOUR
    raised = filled.rollup("1h").filter("max_value = 1000")
    assert [r.bucket.hour for r in raised.collect()] == [21]
    assert filled.rollup("1h").count() == 12 * 24 * 2 + 1


@pytest.mark.parametrize("as_of, begin, until", [
    (10 * DAY, 10 * DAY - 900, 10 * DAY - 300), (10 * DAY + 1, 10 * DAY - 600, 10 * DAY - 300),
])
def test_band_edges(as_of, begin, until):
    assert rollups.refresh_band("5m", at(as_of)) == (at(begin), at(until))


def snapshot(df):
    return tuples(df, *KEYS)


@pytest.mark.parametrize("file_format", ["parquet", "json.gz"])
def test_archive_moves_and_unified_scan_restores(spark, filled, file_format):
    before = snapshot(filled.samples())
    metric_id = filled.resolve("temp")["id"]
    mine = [row for row in before if row[0] == metric_id]
    filled.archive(at(35 * DAY), file_format)
    hot = snapshot(filled.samples())
    assert min(r[2] for r in hot).day == 6 and len(hot) == 7 * 24 * 2
    assert filled.manifest().count() == 5 * 2
    row = filled.manifest().orderBy("start_time").first()
    assert row.row_count == 24 and row.file_size_bytes > 0 and row.file_format == file_format
    assert snapshot(filled.read_archive(metric_id, at(0), at(40 * DAY))) == [r for r in mine if r not in hot]
    part = filled.read_archive(metric_id, at(DAY + HOUR), at(DAY + 3 * HOUR))
    assert part.count() == 2  # exact time filter, not whole files
    assert snapshot(filled.unified_samples("temp", at(0), at(40 * DAY))) == mine
    # Repeating changes nothing.
    filled.archive(at(35 * DAY), file_format)
    assert snapshot(filled.samples()) == hot and filled.manifest().count() == 10
    # A corrected and a late sample of an archived day join what the archive holds.
    filled.ingest(incoming(spark, [gauge(0, 17, 555), gauge(1, 18, 1)]), at(40 * DAY), "late")
    for _ in range(2):
        both = snapshot(filled.unified_samples("temp", at(0), at(40 * DAY)))
        assert len(both) == len(mine) + 1 and 555.0 in [r[3] for r in both]
        filled.archive(at(35 * DAY), file_format)
        assert snapshot(filled.samples()) == hot
    stats = archive.archive_stats(filled.manifest()).filter(F.col("metric_id") == metric_id).first()
    assert (stats.file_count, stats.total_rows) == (5, 121)
    assert filled.labels_index().agg(F.sum("row_count")).first()[0] == 241


def answers(store):
    """One answer of every kind over the whole range."""
    end = at(12 * DAY)
    return [
        tuples(query(store, limit=10_000), "timestamp", "value"),
        tuples(query(store, aggregation=Aggregation.AVG, interval="1h"), "timestamp", "value"),
        tuples(store.routed_query(QueryRequest("temp", at(0), end, {}, Aggregation.SUM, "1d"), end, scan_rows=0), "timestamp", "value"),
        [tuple(r) for r in store.statistics("temp", end, at(0), end).collect()],
        tuples(store.counter_rate("hits", at(0), end), "time", "rate"),
        tuples(store.instant("temp", at(HOUR + 20)), "timestamp", "value"),
    ]


def test_answers_do_not_depend_on_the_jobs_that_ran(spark, filled):
    before = answers(filled)
    filled.archive(at(35 * DAY))
    assert answers(filled) == before
    filled.refresh_rollups()
    assert answers(filled) == before
    assert filled.rollup("1d").count() == 12 * 3  # rollups of archived days stay


def test_routing_trusts_only_complete_rollups(spark, registered, folder):
    store = copied(spark, registered, folder)
    rows = [gauge(i, i * HOUR, i) for i in range(44)]
    store.ingest(incoming(spark, rows), at(3 * DAY), "b1")
    request = QueryRequest("temp", at(0), at(2 * DAY), {}, Aggregation.COUNT, "1h")

    def check():
        want = tuples(store.query(request, at(3 * DAY)), "timestamp", "value")
        assert tuples(store.routed_query(request, at(3 * DAY), scan_rows=0), "timestamp", "value") == want
        return len(want)

    assert check() == 44 and store.valid_days("1h") == []  # never built
    store.merge_incoming()
    store.refresh_rollups()
    assert check() == 44 and len(store.valid_days("1h")) == 2
    store.ingest(incoming(spark, [gauge(0, 47 * HOUR, 7)]), at(3 * DAY), "b2")
    assert check() == 45 and store.valid_days("1h") == [date(2024, 1, 1)]  # a late sample
    store.merge_incoming()
    assert check() == 45
    store.refresh_band("1h", at(2 * DAY + HOUR))
    assert check() == 45 and store.valid_days("1h") == [date(2024, 1, 1)]  # a part of the day
    store.refresh_rollups()
    assert check() == 45 and len(store.valid_days("1h")) == 2


def test_failed_retention_and_purge_keep_their_tables(spark, filled, monkeypatch):
    before = snapshot(filled.samples())
    failing_commit(monkeypatch, 0)
    with pytest.raises(OSError):
        filled.apply_retention(at(12 * DAY))
    monkeypatch.undo()
    assert snapshot(filled.samples()) == before
    filled.archive(at(35 * DAY))
    failing_commit(monkeypatch, 0)
    with pytest.raises(OSError):
        filled.purge_manifest(at(60 * DAY))
    monkeypatch.undo()
    assert filled.manifest().count() == 10


def test_archive_survives_a_crash_before_the_delete(spark, filled, monkeypatch):
    before = snapshot(filled.samples())
    monkeypatch.setattr(tables, "drop_days", lost)
    with pytest.raises(OSError):
        filled.archive(at(35 * DAY))
    monkeypatch.undo()
    metric_id = filled.resolve("temp")["id"]
    unified = snapshot(filled.unified_samples("temp", at(0), at(40 * DAY)))
    assert unified == [r for r in before if r[0] == metric_id]
    filled.archive(at(35 * DAY))
    assert len(snapshot(filled.samples())) == 7 * 24 * 2 and filled.manifest().count() == 10


def test_archive_mixed_formats(filled):
    filled.archive(at(33 * DAY), "parquet")
    filled.archive(at(35 * DAY), "json.gz")
    metric_id = filled.resolve("temp")["id"]
    assert filled.read_archive(metric_id, at(0), at(40 * DAY)).count() == 120
    assert filled.labels_index().count() == 5 * 3
    filled.purge_manifest(at(34 * DAY))
    assert {r.day for r in filled.manifest().collect()} == {date(2024, 1, 4), date(2024, 1, 5)}


def test_missing_archive_folder_raises(filled):
    filled.archive(at(35 * DAY))
    path = filled.manifest().filter("day = '2024-01-02'").first().storage_path
    tables.delete(filled.spark, f"{filled.path('archive')}/{path}")
    metric_id = path.split("metric_id=")[1]
    with pytest.raises(Exception):
        filled.read_archive(metric_id, at(0), at(40 * DAY)).count()


def test_retention_per_metric(filled):
    filled.apply_retention(at(12 * DAY))
    hits, temp = values(filled, "hits"), values(filled, "temp")
    assert len(temp) == 288 and len(hits) == 120
    filled.apply_retention(at(200 * DAY))
    assert filled.samples().isEmpty()


@pytest.mark.parametrize("kind", ["JSON", "CSV", "PROMETHEUS"])
def test_export(spark, frozen, kind):
    filled = frozen
    path = scratch_path(spark, "export")
    filled.export("temp", at(0), at(12 * DAY), kind, path, {"room": "a"})
    lines = [r.value for r in spark.read.text(path).collect()]
    if kind == "JSON":
        first = json.loads(lines[0])
        assert first["labels"] == {"room": "a"} and first["timestamp"].endswith("Z")
        assert len(lines) == 144
    elif kind == "CSV":
        assert "timestamp,metric,value,labels" in lines
        assert '2024-01-01T00:00:17.000000Z,temp,0.0,"{""room"":""a""}"' in lines
    else:
        assert 'temp{room="a"} 0.0 1704067217000' in lines
    with pytest.raises(ValueError):
        filled.export("temp", at(0), at(31 * DAY), kind, path)


def test_json_batches(spark, folder):
    good = {"metrics": [
        {"name": "temp", "value": 1.5, "timestamp": "2024-01-01T00:00:00.000001Z", "labels": {"room": "a"}},
        {"name": "temp", "value": 2, "timestamp": "  "},
        {"name": "temp", "value": 3, "timestamp": "yesterday", "type": "GAUGE"},
    ]}
    path = scratch_path(spark, "json")
    os.makedirs(path)
    for name, text in {"a": json.dumps(good, indent=2), "b": '{"metrics": [', "c": '{"metrics": []}'}.items():
        with open(f"{path}/{name}.json", "w") as out:
            out.write(text)
    rows = read_samples_json(spark, path).collect()
    problems = sorted((r.problem or "", r.idx) for r in rows)
    assert problems == [("", 0), ("", 1), ("batch_empty", 0), ("malformed", 0), ("timestamp_invalid:yesterday", 2)]
    capped = read_samples_json(spark, f"{path}/a.json", max_batch=2)
    assert {r.problem for r in capped.collect()} == {"batch_too_large"}


def write_lines(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as out:
        for row in rows:
            out.write((row if isinstance(row, str) else json.dumps(row)) + "\n")


def line(seconds, value, room="a", name="temp"):
    return {"name": name, "value": value, "timestamp": at(seconds).isoformat().replace("+00:00", "Z"),
            "labels": {"room": room}}


def test_ndjson(spark, folder):
    path = scratch_path(spark, "ndjson")
    twice = '{"name": "twin", "value": 1, "timestamp": "\\t\\n", "labels": {"a": "1", "b": "x", "a": "2"}}'
    write_lines(path, "x.json", [line(0, 1), '{"name": "temp", "val', line(1, 2), twice])
    rows = read_samples_ndjson(spark, path).collect()
    assert sorted((r.problem or "", r.name) for r in rows) == [
        ("", "temp"), ("", "temp"), ("", "twin"), ("malformed", '{"name": "temp", "val')]
    twin = next(r for r in rows if r.name == "twin")
    assert twin.labels == {"a": "2", "b": "x"} and twin.timestamp is None


def test_stream_restarts_and_equals_batch(spark, store, folder):
    path, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "checkpoint")

    def run():
        stream_ingest(store, path, checkpoint, clock=lambda: at(10 * DAY), available_now=True,
                      max_files=1).awaitTermination()

    write_lines(path, "1.json", [line(0, 1), line(0, 2), line(5, 3, "b"), "broken"])
    run()
    assert [v for *_, v in values(store)] == [2.0, 3.0]
    run()  # nothing new
    write_lines(path, "2.json", [line(0, 9), line(DAY, 4)])
    write_lines(path, "3.json", [line(400 * DAY, 5), line(7, 6)])
    run()
    assert sorted(v for *_, v in values(store)) == [3.0, 4.0, 6.0, 9.0]
    store.merge_incoming()
    assert sorted(v for *_, v in values(store)) == [3.0, 4.0, 6.0, 9.0]
    totals = store.ingest_totals().first()
    assert (totals["total_accepted"], totals["total_rejected"]) == (6, 2)
