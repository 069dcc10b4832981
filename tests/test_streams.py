from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import at, samples, tuples
from seriesframe.operators import counters, rollups
from seriesframe.session import scratch_path, shared_dir
from seriesframe.functions.times import utc_day
from seriesframe.schema import ROLLUP
from seriesframe.sources import tables
from seriesframe.sources.files import partitions
from seriesframe.sources.tables import read_table
from seriesframe.streaming.ingest import dedup_first_wins, start
from seriesframe.streaming import rates
from seriesframe.streaming.rates import current_rates, stream_rate
from seriesframe.streaming.rollups import write_stream_rollup

COLUMNS = ["time", "metric_id", "labels_key", "value"]


@pytest.fixture
def source(spark):
    path = scratch_path(spark, "source")

    def add(rows):
        samples(spark, rows).select(*COLUMNS).write.mode("append").parquet(path)

    def stream():
        schema = "time timestamp, metric_id string, labels_key string, value double"
        return spark.readStream.schema(schema).parquet(path)

    return add, stream


def run_rate(spark, stream, folder, checkpoint):
    stream_rate(stream(), f"{folder}/out", f"{folder}/state", checkpoint,
                max_series_rows=20, available_now=True).awaitTermination()
    return tuples(current_rates(spark, f"{folder}/out"), "metric_id", "labels_key", "time", "rate")


def batch_rates(spark, rows):
    return tuples(counters.rate(samples(spark, rows), 10**9), "metric_id", "labels_key", "time", "rate")


def test_late_samples_get_a_rate_and_correct_the_next_one(spark, source, folder):
    add, stream = source
    checkpoint = scratch_path(spark, "checkpoint")
    first = [(0, "m", 10, {}), (10, "m", 20, {}), (0, "n", 5, {}), (20, "m", 40, {}), (30, "m", 50, {})]
    late = [(40, "m", 5, {}), (15, "m", 30, {}), (10, "n", 25, {})]
    add(first)
    assert [r for *_, r in run_rate(spark, stream, folder, checkpoint)] == [1.0, 2.0, 1.0]
    add(late)
    assert run_rate(spark, stream, folder, checkpoint) == batch_rates(spark, first + late)
    # The second batch wrote its own three samples and the one after the late sample, no more.
    assert spark.read.parquet(f"{folder}/out/batch=1").count() == 4


@pytest.mark.parametrize("merge_after", [2, 64])
def test_shuffled_arrivals_give_the_batch_rates(spark, source, folder, monkeypatch, merge_after):
    """Over days, with series that miss days, in any order; batches are merged on the way."""
    add, stream = source
    monkeypatch.setattr(rates, "MERGE_AFTER", merge_after)
    checkpoint = scratch_path(spark, "checkpoint")
    rng = random.Random(merge_after)
    moments = sorted(rng.sample(range(0, 9 * 86_400, 1_800), 130))
    rows = [(t, "hot", rng.randrange(0, 50), {"s": "a"}) for t in moments]
    rows += [(t, "cold", rng.randrange(0, 50), {"s": rng.choice("xyz")}) for t in moments[::3]]
    rng.shuffle(rows)
    for at_once in range(0, len(rows), 35):
        add(rows[at_once:at_once + 35])
        got = run_rate(spark, stream, folder, checkpoint)
    assert got == batch_rates(spark, rows)
    if merge_after == 2:
        assert partitions(spark, f"{folder}/state/samples", "run") == ["0", "1"]
        assert partitions(spark, f"{folder}/state/samples", "batch") == ["2", "3", "4"]


def test_a_value_sent_again_replaces_the_earlier_one(spark, source, folder):
    add, stream = source
    checkpoint = scratch_path(spark, "checkpoint")
    day = 86_400
    for rows in ([(0, "m", 10, {}), (day, "m", 20, {}), (2 * day, "m", 90, {})], [(day, "m", 30, {})],
                 [(5, "m", 12, {})], [(day, "m", 40, {}), (day, "m", 35, {})]):
        add(rows)
        got = run_rate(spark, stream, folder, checkpoint)
    last = [(0, "m", 10, {}), (5, "m", 12, {}), (day, "m", 40, {}), (2 * day, "m", 90, {})]
    assert got == batch_rates(spark, last)


def test_a_retried_batch_changes_nothing(spark, folder):
    """The state that a failed attempt left of its own batch is not read again."""
    held = rates._Held(f"{folder}/samples", rates.HELD, rates.newest_values)
    row = samples(spark, [(0, "m", 1, {})]).withColumn("batch", F.lit(3).cast("long"))
    held.write(row.select(*rates.HELD.names), "batch=3")
    assert held.before(spark, 3).count() == 0 and held.before(spark, 4).count() == 1
    held.write(row.select(*rates.HELD.names), "batch=3")
    assert held.before(spark, 4).count() == 1
    assert held.before(spark, 4, [at(86_400).date()]).count() == 0


def test_rates_of_nothing_and_null_keys(spark, source, folder):
    add, stream = source
    assert current_rates(spark, f"{folder}/out").count() == 0
    add([(0, "m", 1, {}), (None, "m", 2, {}), (1, None, 3, {}), (1, None, 4, {})])
    assert run_rate(spark, stream, folder, scratch_path(spark, "checkpoint")) == []


def test_closed_buckets_equal_the_batch_rollup(spark, source, folder):
    add, stream = source
    rows = [(i * 97, "m", i, {"s": str(i % 3)}) for i in range(200)]
    add(rows[:120])
    checkpoint = scratch_path(spark, "checkpoint")
    for more in ([], rows[120:]):
        if more:
            add(more)
        write_stream_rollup(stream(), "5m", folder, checkpoint, available_now=True).awaitTermination()
    closed = at(rows[-1][0] - 900 - 300)
    keys = ["bucket", "metric_id", "labels_key", "sum_value", "sample_count"]
    batch = rollups.rollup(samples(spark, rows), "5m")
    want = [r for r in tuples(batch, *keys) if r[0] <= closed.replace(tzinfo=None)]
    table = read_table(spark, folder, ROLLUP)
    assert tuples(table, *keys) == want
    # A batch refresh and the stream write the same table.
    tables.overwrite_days(batch.withColumn("day", utc_day("bucket")), folder)
    assert tuples(read_table(spark, folder, ROLLUP), *keys) == tuples(batch, *keys)


def test_dedup(spark, source, folder):
    add, stream = source
    add([(0, "m", 1, {}), (0, "m", 2, {}), (5, "m", 3, {}), (5, "m", 3, {"a": "1"})])
    writer = dedup_first_wins(stream(), "1 hour").writeStream.format("parquet").option("path", folder)
    start(writer, scratch_path(spark, "checkpoint"), True, "").awaitTermination()
    assert spark.read.parquet(folder).count() == 3


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert shared_dir(spark) == shared_dir(spark)
