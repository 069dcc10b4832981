"""Small document tables and comparisons for the tests of this folder."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: dict[str, str] | None = None):
    """Rows of (doc_id, text[, lang, source]); ``extra`` adds columns by name."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, DOCS)
    for name, value in (extra or {}).items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df
