"""The corpus pipeline: good documents, without repeated lines, near copies and personal data, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.llm import lines, neardup, packing, pii, sites
from seriesframe.llm.registered import BYTE_BPE
from seriesframe.session import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the site-aware quality classifier keeps."""
    return sites.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line at its first place only; documents of repeated lines alone go."""
    return _counted(lines.drop_repeated(docs, min_chars=lines.ALL_LINES))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _counted(pii.mask_pii(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None  # no stage can be put in SQL; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
