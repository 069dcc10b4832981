"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 1_000_000


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, so that further columns cannot clash with its own."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )


def text_chunks(
    batches: Iterable[pa.RecordBatch], chars: int = CHUNK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str | None] | list[bytes | None]]]:
    """(rows, their texts) in runs of about ``chars`` characters, or bytes if the texts are binary; one
    long text is its own run.

    Only the texts of one run are Python objects at a time, whatever the size of a batch.
    """
    for batch in batches:
        text = batch.column("text")
        binary = pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type)
        length = pc.binary_length if binary else pc.utf8_length
        lengths = pc.fill_null(length(text), 0).to_pylist()
        begin, size = 0, 0
        for i, length in enumerate(lengths):
            size += length + 1
            if size >= chars or i == len(lengths) - 1:
                rows = batch.slice(begin, i + 1 - begin)
                yield rows, rows.column("text").to_pylist()
                begin, size = i + 1, 0


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    The driver serves the archive, so nothing has to be installed on the cluster.
    """
    if spark.sparkContext.applicationId in _shipped:
        return
    package, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(_single_threaded(function), schema)


def _single_threaded(function: Callable) -> Callable:
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        yield from function(batches)
        release()

    return run


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and later stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def hash_share(column: Column | str, share: float) -> Column:
    """True for a fixed pseudo-random ``share`` of the values of ``column``."""
    return F.pmod(F.xxhash64(F.lit("share"), column), F.lit(1_000_000)) < int(share * 1_000_000)
