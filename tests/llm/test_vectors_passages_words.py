from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesframe.llm import spelling, substrings, vectorcodes
from seriesframe.llm.arrow import text_chunks
from llm_helpers import documents

# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, integer vector); codes and errors by comparing everything."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // parts
    cut = np.array([r[2] for r in rows]).reshape(len(rows), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def near(p):
        apart = ((cut[:, p, None, :] - books[p][None]) ** 2).sum(2)
        return apart.argmin(1), apart.min(1)

    for _ in range(rounds):
        for p in range(parts):
            chosen, _ = near(p)
            for e in set(chosen.tolist()):
                own = cut[chosen == e, p]
                books[p, e] = np.floor_divide(own.sum(0), len(own))
    found = [near(p) for p in range(parts)]
    errors = sum(f[1] for f in found)
    labels = Counter()
    for (_, label, _), error in zip(rows, errors.tolist()):
        labels[label] += error
    return sorted(
        (repr(r[0]), [int(f[0][i]) for f in found], int(errors[i]), labels[r[1]]) for i, r in enumerate(rows)
    ), books


@pytest.mark.parametrize("block", [1, 3, 512])
@pytest.mark.parametrize("values", [2, 50])
def test_trie_distances(block, values):
    rng = np.random.default_rng(values)
    parts = np.unique(rng.integers(-values, values, (300, 5)), axis=0)
    entries = rng.integers(-values, values, (7, 5))
    seen = 0
    for begin, end, apart in vectorcodes.leaves(parts, entries, block):
        assert begin == seen
        seen = end
        assert (apart == ((parts[begin:end, None] - entries[None]) ** 2).sum(2)).all()
    assert seen == len(parts)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in ("vector", "codes", "error", "of", "position")})


def test_vector_codes(spark):
    rng = random.Random(1)
    good = [(i % 90 if i % 7 else None, [rng.randint(-6, 6) / 64 for _ in range(8)], rng.choice([1, 2, None])) for i in range(150)]
    good += [good[3]] * 20 + [(7, [0.0] * 8, 1), (8, [0.0] * 8, None)]
    bad = [(1, None, 1), (2, [None] + [0.0] * 7, 1), (3, [float("nan")] * 8, 2), (0, [float("inf")] * 8, 2), (4, [1.0] * 4, 3)]
    made, books = vectorcodes.compress(vectors(spark, good + bad).repartition(4), parts=4, entries=16)
    want, plain = plain_codes([(i, lab, [int(np.floor(1024 * x)) for x in v]) for i, v, lab in good], 4, 16, 4)
    assert (books == plain).all()
    assert sorted((repr(r.vec_id), r.codes, r.error, r.label_error) for r in made.collect()) == want
    assert made.columns == ["vec_id", "label", "codes", "error", "label_error"]


def test_no_vectors(spark):
    made, books = vectorcodes.compress(vectors(spark, [(1, None, 1)]))
    assert made.collect() == [] and books is None and len(vectorcodes.digest(books)) == 64
    with pytest.raises(ValueError):
        vectorcodes.compress(vectors(spark, [(1, [1.0] * 5, 1)]))


# Repeated passages


def plain_removed(rows, window):
    first = {}
    order = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for own, text in zip(order, words):
        for s in range(len(text) - window + 1):
            key = tuple(text[s : s + window])
            first[key] = min(own, first.get(key, own))
    out = []
    for (doc_id, _), own, text in zip(rows, order, words):
        gone = set()
        for s in range(len(text) - window + 1):
            if first[tuple(text[s : s + window])] < own:
                gone |= set(range(s, s + window))
        out.append((repr(doc_id), len(text), len(gone), " ".join(w for i, w in enumerate(text) if i not in gone)))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ab", "é\xa0", "x\x1cy", " ", "Z"]

    def some(n):
        return rng.choices(vocabulary, k=n)

    passage, other = some(30), some(14)
    rows = []
    for i in range(120):
        text = some(rng.randint(0, 25))
        if i % 3 == 0:
            text += passage[: rng.randint(8, 30)] + some(rng.randint(0, 9))
        if i % 5 == 0:
            text = other * rng.randint(1, 4) + text
        rows.append((rng.choice([i, i, i % 20, None]), rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [rows[0]] * 5 + [(500, None), (501, ""), (502, " \n"), (503, " ".join(some(20_000) + passage))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [
    {"window": 12, "anchor": 3}, {"window": 12, "anchor": 3, "shard_words": 40, "key_words": 40},
    {"window": 2, "anchor": 1}, {"window": 8, "anchor": 8, "key_words": 100},
])
def test_repeated_passages(spark, options):
    rows = passages(len(options))
    docs = documents(spark, rows, {"owner": "x", "text_key": "y", "gone": "z", "key": "k"}).repartition(6)
    made = substrings.drop_repeats(docs, **options).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.text) for r in made) == plain_removed(rows, options["window"])


def test_common_passage_is_refined(spark):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(70)]
    rows = [(i, " ".join([f"l{rng.random()}" for _ in range(60)] + passage + [f"r{rng.random()}" for _ in range(60)])) for i in range(90)]
    made = substrings.drop_repeats(documents(spark, rows), key_words=500, shard_words=1000).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.text) for r in made) == plain_removed(rows, 50)
    assert sum(r.n_removed for r in made) == 89 * 70


def test_no_documents_have_no_passages(spark):
    assert substrings.drop_repeats(documents(spark, [])).collect() == []


@pytest.mark.parametrize("kind", [pa.string(), pa.binary(), pa.large_binary()])
def test_runs_of_texts_and_of_bytes(kind):
    texts = ["ab", None, "", "x" * 9, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()).cast(kind)], ["text"])
    runs = [own for _, own in text_chunks([batch, batch.slice(0, 0)], 5)]
    assert [len(own) for own in runs] == [3, 1, 1]
    assert sum(runs, []) == batch.column("text").to_pylist()


def test_halves_cover_every_window_once():
    words = [b"%d" % i for i in range(21)]
    for before in range(4, 14):
        parts = substrings.halves(words, 10, before, 0, 9 + 6, 12)
        covered = sorted(first + k for first, windows, *_ in parts for k in range(windows))
        assert covered == list(range(max(0, before - 15), min(9, before) + 1))


def test_backward_search_counts():
    rng = np.random.default_rng(0)
    tokens = np.append(rng.integers(1, 4, 300), 0)
    index = substrings.FMIndex(tokens, 8)
    for _ in range(200):
        pattern = rng.integers(1, 4, rng.integers(1, 9))
        low, high = np.array([0]), np.array([index.size])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        places = [i for i in range(300) if tokens[i : i + len(pattern)].tolist() == pattern.tolist()]
        assert sorted(index.suffixes[low[0] : high[0]].tolist()) == places


# Spelling variants


def plain_variants(counts, min_chars, min_count, ratio):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out, form = {}, {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        if others and words[others[0]] >= ratio * n:
            form[w] = others[0]
        out[w] = (n, len(others))

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, near_n, words[form[w]] if w in form else None) for w, (n, near_n) in out.items())


def test_neighbours_by_rotations(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choices("abà", k=rng.randint(1, 5))): rng.choice([1, 1, 2, 5, 10, 60, 400]) for _ in range(150)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_variants(counts, 1, 1, 5)
    near = {r.word: (r.best, r.best_n, r.n_near) for r in spelling.neighbours(words.repartition(5)).collect()}
    assert {w: near[w][2] for w in counts} == {w[0]: w[4] for w in want}
    assert all(near[w[0]][:2] == (w[1], w[5]) for w in want if w[1])


def test_variants(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcÀéü", k=rng.randint(1, 4))) for _ in range(40)]
    rows = [(rng.choice([i, None, 7]), " ".join(rng.choices(words, weights=range(1, 41), k=200)).upper()) for i in range(30)]
    rows += [(1, None), (2, ""), (3, "12 -- ×"), rows[0], rows[0], (4, "abcab " * 30_000)]
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 11 == 0 else run] += 1
    counts.pop("", None)
    docs = documents(spark, rows, {"word": "x", "n": "y", "prefix": "z"}).repartition(4)
    made = spelling.variants(docs, min_chars=2, min_count=3, ratio=2, misspell=11)
    assert sorted(tuple(r) for r in made.collect()) == plain_variants(counts, 2, 3, 2)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(documents(spark, [])).collect() == []
