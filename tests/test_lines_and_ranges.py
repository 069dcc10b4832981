"""Line numbers over file splits, and day ranges as aligned blocks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesframe.operators import archive
from seriesframe.sources.samples import read_samples_ndjson


def test_lines_are_numbered_over_splits(spark, folder):
    text = F.concat(F.lit('{"name": "n'), "id", F.lit('", "value": 1.0}'))
    rows = spark.range(6000).select(
        (F.col("id") % 3).alias("part"), "id",
        F.when(F.col("id") % 50 == 7, "").when(F.col("id") % 50 == 8, '{"name": ').otherwise(text).alias("line"),
    )
    rows.repartition("part").sortWithinPartitions("part", "id").drop("id").write.partitionBy("part").text(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        made = read_samples_ndjson(spark, folder)
        assert made.rdd.getNumPartitions() > 6
        got = sorted((r.idx, r.name) for r in made.filter("problem IS NULL").select("idx", "name").collect())
        bad = sorted(r.idx for r in made.filter("problem = 'malformed'").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, malformed = [], []
    for part in range(3):
        lines = [i for i in range(part, 6000, 3) if i % 50 != 7]
        want += [(place, f"n{i}") for place, i in enumerate(lines) if i % 50 != 8]
        malformed += [place for place, i in enumerate(lines) if i % 50 == 8]
    assert got == sorted(want) and bad == sorted(malformed)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_tile_a_range(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, a + rng.choice([-1, 0, 1, 5, rng.randint(0, 4000)])) for a in (rng.randint(0, 5000) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("cover", archive.dyadic_cover(F.col("a"), F.col("b"), 14))
    for row in df.collect():
        days = [day for at in row.cover for day in range(at.block << at.level, (at.block + 1) << at.level)]
        assert sorted(days) == list(range(row.a, row.b + 1))
        assert len(row.cover) <= 2 * max(1, (row.b - row.a + 1).bit_length())


def test_ranges_of_any_length(spark):
    begin = datetime(1960, 2, 27)
    manifest = [("m", (begin + timedelta(days=n)).date(), begin + timedelta(days=n), begin + timedelta(days=n + 1), n) for n in range(0, 9000, 13)]
    files = spark.createDataFrame(manifest, "metric_id string, day date, start_time timestamp, end_time timestamp, row_count long")
    rng = random.Random(5)
    ranges = []
    for q in range(60):
        start = begin + timedelta(hours=rng.randint(-3000, 220_000))
        ranges.append((q, rng.choice("mn"), start, start + timedelta(hours=rng.choice([0, 1, 24, 5000, 300_000, -30]))))
    made = archive.manifest_for_ranges(files, spark.createDataFrame(ranges, "query_id int, metric_id string, start timestamp, end timestamp"))
    want = sorted((q, n) for q, m, start, end in ranges if m == "m" and start <= end
                  for _, _, low, high, n in manifest if low <= end and high >= start)
    assert sorted((r.query_id, r.row_count) for r in made.collect()) == want
    assert archive.manifest_for_ranges(files, spark.createDataFrame([], "query_id int, metric_id string, start timestamp, end timestamp")).isEmpty()
