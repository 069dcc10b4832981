from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import check_oracle
import corpus_pipeline
from llm_helpers import documents
from seriesframe.llm import lines, neardup, registered

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and set(registered.QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))
    assert set(registered.ORACLES) <= set(contract.oracle_sql())


def test_stages_take_effect_on_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count(), name
        assert kept.join(before, "doc_id", "left_anti").isEmpty(), name
        assert kept.filter("n_chars <> length(text)").isEmpty(), name
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept.join(labels, "doc_id").filter("quality = 0").count() <= 2
    assert lines.line_classes(kept).filter("NOT first").isEmpty()
    packed = corpus_pipeline.pack(spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_run_gives_the_last_stage(spark):
    made = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(made.columns) and made.count() > 0


def test_which_queries_have_sql():
    assert sorted(registered.ORACLES) == ["op11_vector_codes", "op12_substrings", "op13_spelling", "op3_url_filter"]


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_equals_sql(spark, name):
    good, note = check_oracle.compare(spark, check_oracle.connect(SF), SF, name)
    assert good, note


def test_columns_that_clash_keep_their_values(spark):
    """Rows that stay do so with all their values, whatever their columns are called."""
    names = ["nd_key", "nd_node", "nd_id", "nd_first", "node", "row", "first_node", "first_id", "own_id", "ld_text",
             "ld_id", "ld_key", "ld_gone", "gone", "kept", "of_id", "of_key", "text_key"]
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "a line of its own\n\nb"), (4, None)]
    docs = documents(spark, rows).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for made, gone in ((neardup.keep_one(docs), {2}), (lines.drop_repeated(docs, min_chars=lines.ALL_LINES), {2})):
        assert made.columns == docs.columns
        want = sorted(repr(r) for r in docs.collect() if r.doc_id not in gone)
        assert sorted(map(repr, made.collect())) == want


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (None, None), (3, "x " * 200_000), (3, "x " * 200_000), (None, "good words in a line\n\nand more"), (7, "12")],
])
def test_stages_on_odd_documents(spark, rows):
    docs = documents(spark, rows, {"label": "l", "piece": "p", "ids": "i", "nd_id": "n", "ld_gone": "g", "path": "q"})
    seen = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in docs.collect()} <= {i for i, _ in seen}
        assert docs.filter("ids <> 'i' OR nd_id <> 'n' OR ld_gone <> 'g' OR label <> 'l'").isEmpty()
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
