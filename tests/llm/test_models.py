from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import documents
from seriesframe.llm import langid, registered, rules, sites

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    made = registered.op1_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = made.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_are_cosines_of_bundled_vectors():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(30)) for _ in range(5)]
    prototypes = np.random.default_rng(1).normal(size=(3, 2048)).astype(np.float32)
    profiles = langid.Profiles(("x", "y", "z"), prototypes, 7)
    cosines, lettered = langid.Scorer(profiles).cosines(texts)
    assert lettered.all()
    for text, got in zip(texts, cosines):
        keys, _ = langid.ngrams_of([text])
        vector = langid.ngram_vectors(keys, 2048, 7).sum(0)
        want = prototypes @ vector / np.linalg.norm(prototypes, axis=1) / np.linalg.norm(vector)
        assert got.argmax() == want.argmax()
        assert np.allclose(got, want, atol=0.02)


def test_ngrams_do_not_cross_words_or_texts():
    keys, owner = langid.ngrams_of(["Ab c", None, "", "1 2", "é"])
    spelled = ["".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in keys.tolist()]
    assert list(zip(owner.tolist(), spelled)) == [(0, " ab"), (0, "ab "), (0, " c "), (4, " é ")]


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (2, "le chat et le chien", "fr"),
            (3, None, "en"), (4, "", None), (5, "123 !!", "fr"), (None, "the the", "en"), (6, "word " * 200_000, None)]
    docs = documents(spark, [(*r, "s") for r in rows], {"score": "x", "at": "y"})
    made = langid.identify(docs, langid.learn(docs.filter("doc_id < 3"))).collect()
    found = Counter((r.doc_id, r.lang_pred) for r in made)
    assert found[(1, "en")] == 1 and found[(2, "fr")] == 2 and found[(None, "en")] == 1
    assert found[(3, "und")] == found[(4, "und")] == found[(5, "und")] == 1 and len(made) == len(rows)
    nothing = langid.learn(docs.limit(0))
    assert nothing.languages == () and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def brute_facts(text):
    text = text or ""
    space = "\x20\t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in space:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if any(c not in space for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(marked))


def test_rule_facts_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "  \n ", "a\x85b\xa0c d \x1c", "x " * 30, "#*$%&|<>\n" * 4]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "é|", "\t", "d d d d d ", "line\n"], k=rng.randint(0, 60))) for _ in range(150)]
    docs = documents(spark, list(enumerate(texts)), {"kept": "x", "quality": "y", "wanted": "z"})
    model = rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    made = {r.doc_id: r for r in rules.apply_rules(docs, model).collect()}
    for i, text in enumerate(texts):
        r, want = made[i], brute_facts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)  # a model without labels calls everything good
    assert rules.apply_rules(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("query", ["op5_site_quality", "op7_quality_rules"])
def test_verdicts_follow_the_labels(spark, query):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    made = registered.QUERIES[query](spark, sf).select("*")
    if "base_failed" in made.columns:
        made = made.filter("NOT base_failed")
    rows = made.join(labels, "doc_id").select("label", "kept").collect()
    good, bad = ([r.kept for r in rows if r.label == k] for k in (1, 0))
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_quality_model_is_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fit, rest = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("label"))
    rows = rules.apply_rules(docs, rules.train(docs, fit)).join(rest, "doc_id").select("quality", "label").collect()
    assert abs(np.mean([r.quality - r.label for r in rows])) < 0.03
    assert np.mean([(r.quality - r.label) ** 2 for r in rows]) < 0.05


def test_sites_shrink_towards_their_parents(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(3000):
        host = "big" if i % 3 == 0 else "bad" if i % 3 == 1 else f"site{i % 50}"
        rows.append((i, "plain words here " + str(i), "p", host))
        if host != "site0":
            labels.append((i, int(rng.random() < {"big": 0.9, "bad": 0.2}.get(host, 0.6))))
    labels += [(5, None), (None, 1)]
    docs = documents(spark, rows + [(9000, None, None, None), (9001, "x", "p", "never seen")], {"kept": "k", "host": "h"})
    made = {r.doc_id: r for r in sites.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(made) == 3002
    assert made[0].host_posterior > 0.85 and made[1].host_posterior < 0.25
    share = sum(x for _, x in labels[:-2]) / (len(labels) - 2)
    assert abs(made[9001].path_posterior - share) < 0.01 and abs(made[9000].host_posterior - share) < 0.01
    small = made[2]
    assert min(share, 0.4) - 0.1 < small.path_posterior < 0.75


def test_sites_without_labels_or_rows(spark):
    docs, none = documents(spark, [(1, "a b"), (1, "a b"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.path_posterior, r.kept) for r in sites.classify(docs, none).collect()] == [(0.5, True)] * 3
    assert sites.keep_good(docs, none).columns == docs.columns and sites.keep_good(docs, none).count() == 3
    assert sites.classify(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sites.classify(docs, one).filter("kept").count() == 3


def brute_properties(text):
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
    if not words:
        return [0.0] * 8
    single = [c if ord(c) < 256 else "?" for c in text]
    shares = [
        sum(c in set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or 192 <= ord(c) < 223 and ord(c) != 215 for c in single),
        sum(c in "#*$%&|<>{}[]=~^_\\" for c in single), single.count("!"), sum(c in "0123456789" for c in single),
    ]
    n, counts = len(words), Counter(words)
    return [x / len(single) for x in shares] + [
        (len(counts) / n) ** 0.5 if n > 1 else 1.0, max(counts.values()) / n if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines), np.log(n) / 10,
    ]


def brute_shrunk(groups):
    """(n, good, prior) by site -> posterior by site, the strength by moments."""
    seen = sum(n * (g / n - p) ** 2 for n, g, p in groups.values())
    chance = sum(p * (1 - p) for _, _, p in groups.values())
    whole = sum(n * p * (1 - p) for n, _, p in groups.values())
    strength = 10_000.0
    if whole > chance and seen > chance:
        strength = min(max((whole - chance) / (seen - chance) - 1, 2.0), 10_000.0)
    return {k: (g + strength * p) / (n + strength) for k, (n, g, p) in groups.items()}


def test_site_quality_against_brute_force(spark):
    """Properties, regression, both posteriors and the verdict, computed again from their definitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    made = {r.doc_id: r for r in registered.op5_site_quality(spark, SF).collect()}
    assert len(made) == len(docs)
    facts = {r.doc_id: brute_properties(r.text) for r in docs}
    site = {r.doc_id: (r.source or "", r.lang or "") for r in docs}
    known = [i for i in facts if i in labels]
    x, y = np.array([facts[i] for i in known]), np.array([labels[i] for i in known])
    mean, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    base, ridge = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.diag([1.0] * 8 + [0.0])
    w = np.array([0.0] * 8 + [base])
    for _ in range(100):  # damped Newton steps to the only minimum of a convex loss
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(9), z.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -3, 3)
    prior = (y.sum() + 1) / (len(y) + 2)
    hosts, paths = {}, {}
    for i, good in zip(known, y):
        n, g, _ = hosts.get(site[i][0], (0, 0.0, 0))
        hosts[site[i][0]] = (n + 1, g + good, prior)
    by_host = brute_shrunk(hosts)
    for i, good in zip(known, y):
        n, g, _ = paths.get(site[i], (0, 0.0, 0))
        paths[site[i]] = (n + 1, g + good, by_host[site[i][0]])
    by_path = brute_shrunk(paths)
    for i, fact in facts.items():
        host = by_host.get(site[i][0], prior)
        path = by_path.get(site[i], host)
        evidence = min(max(np.append((np.array(fact) - mean) / spread, 1.0) @ w - base, -30), 30)
        quality = 1 / (1 + np.exp(-(np.log(path / (1 - path)) + evidence)))
        got = made[i]
        assert (got.host_posterior, got.path_posterior) == pytest.approx((host, path), abs=1e-9)
        assert got.evidence == pytest.approx(evidence, abs=0.02) and got.quality == pytest.approx(quality, abs=0.005)
        assert got.kept == (quality >= sites.THRESHOLD) or abs(quality - sites.THRESHOLD) < 0.005


def test_language_query_against_brute_force(spark):
    """Profiles and cosines spelled out: a loop over words, one vector per letter, true lengths."""
    sf = "/root/testdata/sf0.001"
    size, seed, letters, bound = langid.DIMENSIONS, 7, {}, {}

    def letter(c):
        if c not in letters:
            bits = np.random.Generator(np.random.PCG64([seed, ord(c)])).integers(0, 2, size)
            letters[c] = np.where(bits == 1, 1.0, -1.0)
        return letters[c]

    def vector(text):
        total, counts = np.zeros(size), Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            counts.update(padded[k : k + 3] for k in range(len(padded) - 2))
        for gram, n in counts.items():
            if gram not in bound:
                a, b, c = map(letter, gram)
                bound[gram] = np.roll(a, 2) * np.roll(b, 1) * c
            total += n * bound[gram]
        return total

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    vectors = {r.doc_id: vector(r.text) for r in docs}
    prototypes = {}
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + vectors[r.doc_id]
    names = sorted(prototypes)
    unit = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names])
    for r in registered.op1_language(spark, sf).collect():
        own = vectors[r.doc_id]
        if not own.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = unit @ own / np.linalg.norm(own)
        best = np.sort(cosines)[::-1]
        assert r.lang_pred == names[cosines.argmax()] or best[0] - best[1] < 1e-4
        assert r.score == pytest.approx(max(best[0], 0), abs=0.05)
