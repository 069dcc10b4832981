"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from seriesframe.sources.files import delete


def configure(spark: SparkSession) -> SparkSession:
    """Settings the semantics rely on; everything else is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seriesframe-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/seriesframe/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(
    spark: SparkSession, root: str | None = None
) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Intermediate tables of one job, below ``root`` or the shared folder, deleted at its end.

    Queries that return lazy frames use :func:`materialize` instead; what they leave in the
    shared folder is cleaned like Spark's own checkpoints.
    """
    folder = f"{root}/{uuid.uuid4().hex}" if root else scratch_path(spark, "job")

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = f"{folder}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        delete(spark, folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, fixes non-deterministic columns and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
