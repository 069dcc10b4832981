"""Parquet tables under a shared root whose changes take effect at once or not at all.

A write makes a new folder ``version=...``; the table's log then names the folders that hold each
day ("" in a table without days). A log entry is one small file, renamed into place, so a job that
fails at any point leaves the table as it was, and ``df`` may read the table it replaces. Folders
that neither the current nor the last entry names are deleted after the next change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesframe.schema import SERIES
from seriesframe.sources import files
from seriesframe.sources.files import delete, exists, partitions  # noqa: F401

WHOLE = ""
Snapshot = dict[str, list[str]]


# The log


def _entries(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name in files.names(spark, f"{path}/_log") if name.isdigit())


def _entry(spark: SparkSession, path: str, number: int) -> Snapshot:
    return json.loads(files.read_text(spark, f"{path}/_log/{number:012d}"))


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """Folders by day, as of the last change."""
    entries = _entries(spark, path)
    return _entry(spark, path, entries[-1]) if entries else {}


def commit(spark: SparkSession, path: str, changes: Snapshot) -> None:
    """Make ``changes`` the folders of their days; a day without folders leaves the table."""
    entries = _entries(spark, path)
    before = _entry(spark, path, entries[-1]) if entries else {}
    after = {day: held for day, held in {**before, **changes}.items() if held}
    number = entries[-1] + 1 if entries else 1
    if not files.write_new(spark, f"{path}/_log/{number:012d}", json.dumps(after)):
        raise RuntimeError(f"another job has changed {path}; a store takes one writer at a time")
    _tidy(spark, path, entries, {folder for held in [*before.values(), *after.values()] for folder in held})


def _tidy(spark: SparkSession, path: str, entries: list[int], named: set[str]) -> None:
    """Delete what the state before the last one named and the last two do not."""
    for number in entries[:-1]:
        for folder in {f for held in _entry(spark, path, number).values() for f in held} - named:
            delete(spark, f"{path}/{folder}")
        delete(spark, f"{path}/_log/{number:012d}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what failed jobs have left; no other job may be writing the table."""
    named = {
        folder.split("/")[0]
        for number in _entries(spark, path)
        for held in _entry(spark, path, number).values() for folder in held
    }
    for version in files.partitions(spark, path, "version"):
        if f"version={version}" not in named:
            delete(spark, f"{path}/version={version}")


def days_of(spark: SparkSession, path: str) -> list[date]:
    return sorted(date.fromisoformat(day) for day in snapshot(spark, path) if day != WHOLE)


# Reading


def read_table(
    spark: SparkSession, path: str, schema: StructType, first: date | None = None, last: date | None = None
) -> DataFrame:
    """The table, or its days from ``first`` to ``last``; empty while nothing has been written."""
    low, high = (d.isoformat() if d else None for d in (first, last))
    chosen = [
        folder
        for day, held in snapshot(spark, path).items()
        if (low is None or day >= low) and (high is None or day <= high)
        for folder in held
    ]
    return read_folders(spark, path, schema, chosen)


# Writing


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Evenly sized, sorted partitions for a write.

    AQE merges small partitions and splits large ones, whatever day, metric or series they are
    of; the sort order lets row groups be skipped by metric and time.
    """
    return df.hint("rebalance", *keys[:2]).sortWithinPartitions(*keys)


def compact(df: DataFrame, *keys: str) -> DataFrame:
    """Few, evenly sized partitions by ``keys`` for a small table; a hot key is split."""
    return df.hint("rebalance", *keys)


def by_day(df: DataFrame, *keys: str) -> DataFrame:
    moment = "bucket" if "bucket" in df.columns else "time"
    return balanced(df, *(keys or ("day", *SERIES, moment)))


def _write(df: DataFrame, path: str) -> str:
    folder = f"version={uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def _write_days(df: DataFrame, path: str) -> Snapshot:
    folder = f"version={uuid.uuid4().hex}"
    df.write.partitionBy("day").parquet(f"{path}/{folder}")
    days = files.partitions(df.sparkSession, f"{path}/{folder}")
    return {day: [f"{folder}/day={day}"] for day in days}


def write_folder(df: DataFrame, path: str) -> Snapshot:
    """Write rows by day without changing the table; returns the new folders by day."""
    return _write_days(compact(df, "day"), path)


def read_folders(spark: SparkSession, path: str, schema: StructType, folders: Iterable[str]) -> DataFrame:
    full = [f"{path}/{folder}" for folder in folders]
    if not full:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", path).parquet(*full)
    return found.select(*schema.names)


def replace_table(df: DataFrame, path: str) -> None:
    """Make ``df`` the whole table; it may read the table."""
    folder = _write(df, path)
    commit(df.sparkSession, path, {WHOLE: [folder]})


def append_table(df: DataFrame, path: str, most: int = 50) -> None:
    """Add rows; beyond ``most`` folders the table is written anew as one."""
    spark = df.sparkSession
    held = snapshot(spark, path).get(WHOLE, [])
    if len(held) >= most:
        replace_table(read_folders(spark, path, df.schema, held).unionByName(df).coalesce(1), path)
    else:
        commit(spark, path, {WHOLE: [*held, _write(df, path)]})


def append_days(df: DataFrame, path: str, arrange=by_day) -> None:
    spark = df.sparkSession
    made = _write_days(arrange(df), path)
    held = snapshot(spark, path)
    commit(spark, path, {day: [*held.get(day, []), *folders] for day, folders in made.items()})


def overwrite_days(df: DataFrame, path: str, arrange=by_day) -> None:
    """Replace the days that occur in ``df``, which may read them; others stay."""
    commit(df.sparkSession, path, _write_days(arrange(df), path))


def replace_days(df: DataFrame, path: str, days: Iterable[date], arrange=by_day) -> None:
    """Make ``df`` the whole content of ``days``; a day without rows is removed."""
    gone: Snapshot = {day.isoformat(): [] for day in days}
    commit(df.sparkSession, path, gone | _write_days(arrange(df), path))


def drop_days(spark: SparkSession, path: str, days: Iterable[date]) -> None:
    gone: Snapshot = {day.isoformat(): [] for day in days}
    if gone:
        commit(spark, path, gone)


def keyed(*keys: str):
    """An arrangement for tables whose rows are sorted by ``keys``."""
    return lambda df: compact(df, *keys)


def in_days(df: DataFrame, days: Iterable[date]) -> DataFrame:
    return df.filter(F.col("day").isin([F.lit(day) for day in sorted(set(days))]))


