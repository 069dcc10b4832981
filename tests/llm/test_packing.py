from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_helpers import documents
from seriesframe.llm import packing, registered

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def counted(sizes, capacity):
    return np.bincount(np.array(sizes, int), minlength=capacity + 1)


def fewest(sizes, capacity):
    """Optimal number of bins by trying all bins for every piece."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacity}.values():
            bins[k] += sizes[i]
            go(i + 1, bins)
            bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def used(steps, capacity):
    taken = defaultdict(int)
    for step in steps:
        assert sum(s * k for s, k in step.lengths) <= capacity and step.times > 0
        for s, k in step.lengths:
            taken[s] += k * step.times
    return dict(taken)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=11))
def test_plan_is_optimal(sizes):
    steps = packing.plan(counted(sizes, 20), 20)
    assert used(steps, 20) == {s: sizes.count(s) for s in sizes}
    assert sum(s.times for s in steps) == fewest(sizes, 20)
    assert packing.lower_bound(counted(sizes, 20), 20) <= fewest(sizes, 20)


def test_plan_beats_best_fit_where_it_errs():
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 4, 4, 3, 3, 2, 5] * 3
    counts = counted(sizes, 10)
    assert sum(s.times for s in packing.plan(counts, 10)) == packing.lower_bound(counts, 10)


def test_large_counts():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    steps = packing.plan(counts, 1024)
    assert used(steps, 1024) == {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    assert sum(s.times for s in steps) <= packing.lower_bound(counts, 1024) * 1.001 + 1
    assert packing.plan(np.zeros(1025, np.int64), 1024) == []


def test_filling_is_undominated():
    counts = counted([7, 5, 4, 3, 3, 2], 12)
    for chosen in packing.fillings(counts, 9, 10):
        waste = 9 - sum(s * k for s, k in chosen.items())
        own = [s for s, k in chosen.items() for _ in range(k)]
        spare = [s for s in np.flatnonzero(counts) if counts[s] > chosen.get(s, 0)]
        for r in range(len(own) + 1):
            for part in itertools.combinations(own, r):
                assert not any(sum(part) < x <= sum(part) + waste for x in spare)


@pytest.mark.parametrize("length,want", [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]),
                                         (25, [(0, 5), (5, 10), (15, 10)])])
def test_cut(length, want):
    assert packing.cut(length, 10) == want


def check(rows, texts, capacity, end_id):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in by_doc.items():
        ids = [*TOKENIZER.encode(texts[doc_id] or "", add_special_tokens=False).ids, end_id]
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, a, n) for i, (a, n) in enumerate(packing.cut(len(ids), capacity))]
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert "ids" not in r or r.ids == part
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][0] + own[-1][1] <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    return len(by_sequence)


def test_documents(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices(["the", "of,", "née", "x\ny"], k=rng.randint(0, 120))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "word " * 30_000, 1003: "<|endoftext|>"}
    docs = documents(spark, list(texts.items()), {"length": "a", "task": "b", "ids": "c"}).repartition(6)
    rows = packing.pack(docs, PATH, capacity=64, end_id=2).collect()
    assert {r.doc_id for r in rows} == set(texts)
    sequences = check(rows, texts, 64, 2)
    lengths = [r.length for r in rows]
    assert sequences == packing.lower_bound(counted(lengths, 64), 64)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])
    rows = packing.pack(docs, PATH, capacity=8, with_ids=False).collect()
    assert len(rows) == 4 and sum(r.length for r in rows) == 10
    assert sorted(r.doc_id is None for r in rows) == [False, False, True, True]
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 4 and len({s for s, _ in places}) == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registered.op6_packing(spark, sf).collect()
    sequences = check(rows, texts, 1024, 2)
    assert {r.doc_id for r in rows} == set(texts)
    assert sequences <= packing.lower_bound(counted([r.length for r in rows], 1024), 1024) + 1
