from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import documents
from seriesframe.llm import fingerprints, pii, registered

# The base patterns as they are stated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_spans_against_the_patterns():
    rng = random.Random(9)
    for _ in range(20_000):
        text = "".join(rng.choices("a1.23@-+() %é4\n50", k=rng.randint(0, 40)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(text)] == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1(" * 130_000, "@" * 400_000, "1@" * 200_000):
        pii.base_spans(text)
        pii.candidates(text, [])


def planted(spark, n=400):
    """Accounts after a phrase of their own; every fourth one is no valid card number."""
    rng = random.Random(10)
    rows = []
    for i in range(n):
        body = [rng.randint(0, 9) for _ in range(15)]
        check = -sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(body)) % 10
        number = "".join(map(str, [*body, (check + (i % 4 == 0)) % 10]))
        rows.append((i, f"some words {i % 7} more. settle account {number} before noon of the day"))
    rows += [(n + i, f"order of the number {10**15 + 37 * i} and the number of others") for i in range(100)]
    return documents(spark, rows, {"spans": "x", "base": "y", "kind": "z"})


def test_contexts_find_unmatched_identifiers(spark):
    docs = planted(spark)
    made = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find_pii(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in range(400):
        at = texts[i].index("account ") + 8
        assert made[i] == [(at, at + 16, "card")], i
    valid = sum(bool(brute(texts[400 + i])) for i in range(100))
    assert sum(bool(made[400 + i]) for i in range(100)) == valid


def chained(spark):
    """Seeds teach one pattern, what it finds a second one, and that one finds the rest."""
    def bad(i):
        return f"4000 11{i % 90 + 10} 2222 33{i % 80 + 11}"  # spaced, and mostly failing Luhn
    rows = [(i, f"text {i} says member no {4 * 10**15 + i * 7919} here") for i in range(600)]
    rows = [(i, t) for i, t in rows if brute(t)][:40]
    rows += [(1000 + i, f"and member no {bad(i)} here") for i in range(12)]
    rows += [(2000 + i, f"and wire to {bad(i)} please") for i in range(12)]
    rows += [(3000 + i, f"so wire to {bad(60 + i)} please") for i in range(4)]
    return documents(spark, rows)


def brute_bootstrap(rows, min_support=3, min_confidence=0.8):
    """The rules of bootstrapping, spelled out over plain dictionaries: doc_id -> added spans."""
    mentions, edges, seed = [], Counter(), {}
    for doc, text in rows:
        base = pii.base_spans(text)
        for a, b, kind, is_seed in [(*s, True) for s in base] + [(*s, False) for s in pii.candidates(text, base)]:
            form = (kind, text[a:b].lower())
            seed[form] = max(seed.get(form, 0.0), float(is_seed))
            words = text[:a].rstrip("\"'(<[{").split()[-2:]
            patterns = [tuple(w.lower() for w in words[-n:]) for n in range(1, len(words) + 1)]
            edges.update((p, form) for p in patterns)
            mentions.append((doc, a, b, form, is_seed))
    occurs = Counter()
    for _, text in rows:
        words = [w.lower() for w in text.split()]
        occurs.update((w,) for w in words)
        occurs.update(zip(words, words[1:]))
    scores, before = dict(seed), None
    while True:
        weight, support = Counter(), Counter()
        for (p, form), n in edges.items():
            if scores[form] >= min_confidence:
                weight[p, form[0]] += scores[form] * n
                support[p, form[0]] += 1
        strong = {k: min(1.0, weight[k] / (occurs[k[0]] + 1)) for k in weight if support[k] >= min_support}
        state = (set(strong), sum(s >= min_confidence for s in scores.values()))
        if state == before or not strong:
            break
        before, scores = state, {}
        for form in seed:
            miss = 1.0
            for (p, f) in edges:
                if f == form and strong.get((p, form[0]), 0) > 0.1:
                    miss *= 1 - min(strong[p, form[0]], 0.999999)
            scores[form] = max(seed[form], 1 - miss)
    return {(d, a, b, form[0]) for d, a, b, form, is_seed in mentions if not is_seed and scores[form] >= min_confidence}


def test_found_identifiers_induce_patterns_in_turn(spark):
    docs = chained(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spans = pii.bootstrap(pii.scan(docs)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    got = {(r.doc_id, r.start, r.end, r.kind) for r in spans.collect()}
    assert got == brute_bootstrap(rows)
    assert {doc for doc, *_ in got} >= {3000, 3001, 3002, 3003} | {1000}
    once = pii.bootstrap(pii.scan(docs), rounds=1)
    assert once.filter("doc_id >= 3000").isEmpty()


def test_spaced_forms_and_words_of_any_length():
    def pieces(text):
        return {text[a:b] for a, b, _ in pii.candidates(text, [])}
    assert pieces("call (743) 555-3824, please") == {"(743) 555-3824"}
    assert pieces("card 4111 1111 1111 1112.") == {"4111 1111 1111 1112"}
    assert pieces("id 4111111111111112 12") == {"4111111111111112"}
    assert pieces("12 3rd 4567890th") == {"4567890th"}
    assert pieces(" ".join(["77"] * 200_000)) == set()
    long = "a" * 300 + "@" + "b" * 300
    assert pieces(f"mail {long} now") == {long}
    word = "w" * 5000
    assert pii.contexts(f"x {word} 12", 5003) == pii._patterns([pii._word_hash("x"), pii._word_hash(word)])
    assert pii.contexts("ab12", 2) == [] and pii.contexts("12", 0) == []


def test_masking(spark):
    docs = planted(spark)
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns
    rows = {r.doc_id: r.text for r in masked.collect()}
    assert len(rows) == 500 and all("account <card> before" in rows[i] for i in range(400))
    odd = documents(spark, [(1, None), (2, ""), (2, ""), (None, "a@b.cc +1 22 33 44 55 1.2.3.4"), (3, "x" * 500_000)])
    kept = pii.mask_pii(odd).collect()
    assert Counter((r.doc_id, (r.text or "")[:60]) for r in kept) == Counter(
        [(1, ""), (2, ""), (2, ""), (None, "<email> <phone>"), (3, "x" * 60)])
    assert pii.mask_pii(odd.limit(0)).collect() == []


def test_pii_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = registered.op8_pii(spark, sf).collect()
    assert len(made) == len(texts)
    for r in made:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | {""}


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collisions_follow_generalised_jaccard():
    rng, errors = random.Random(11), []
    sampler = fingerprints.Sampler(256)
    for turn in range(60):
        words = [f"{turn}w{i}" for i in range(rng.randint(1, 40))]
        a, b = (Counter({w: rng.choice([1, 1, 2, 5, 30]) for w in words if rng.random() < 0.8}) for _ in range(2))
        x, y = sampler.signatures([a, b])
        if a and b:
            errors.append(fingerprints.likeness(x, y) - jaccard(" ".join(a.elements()), " ".join(b.elements())))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.045


def test_splitting_a_batch_changes_nothing(monkeypatch):
    rng = random.Random(12)
    bags = [Counter(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(0, 60))) for _ in range(50)]
    whole = fingerprints.Sampler().signatures(bags)
    monkeypatch.setattr(fingerprints, "_MOST_TERMS", 100)
    assert (fingerprints.Sampler().signatures(bags) == whole).all()


def test_marks_are_made_for_the_earliest_terms_only(monkeypatch):
    """Three mixed words per term and sample for the draws; the fourth, the mark, once per bag and sample."""
    mixed, real = [], fingerprints._mixed
    monkeypatch.setattr(fingerprints, "_mixed", lambda x: mixed.append(x.size) or real(x))
    sampler = fingerprints.Sampler()
    sampler.signatures([Counter(f"w{i}" for i in range(2000)), Counter(f"w{i}" for i in range(1000))])
    assert sum(mixed) <= (3 * 2000 + 2) * fingerprints.SAMPLES + fingerprints.SAMPLES


def edited(rows):
    """The stated edit, by brute force over rows in order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for (doc_id, _), text, after in zip(order, texts, [*texts[1:], *texts[:1]]):
        half = len(text) // 2
        out.append((doc_id, len(text), text[: len(text) - half] + after[:half], after))
    return out


def test_edited_texts(spark):
    rng = random.Random(13)
    rows = [(i * 3, " ".join(rng.choices(["é", "the", "x\ny", "b" * 9], k=rng.randint(0, 50)))) for i in range(200)]
    rows += [(9, "again"), (9, None), (None, "no id"), (None, ""), (700, "long " * 100_000), (700, "long " * 100_000)]
    docs = documents(spark, rows, {"run": "x", "place": "y", "order": "z"}).repartition(7)
    for chars in (500, 10**9):
        dealt = fingerprints.with_next(docs, "doc_id", "text", chars)
        assert dealt.filter("place = 0").count() == len(rows)
        original, fingerprints.with_next.__defaults__ = fingerprints.with_next.__defaults__, (chars,)
        try:
            made = fingerprints.compare_edited(docs).collect()
        finally:
            fingerprints.with_next.__defaults__ = original
        want = edited(rows)
        assert Counter((r.doc_id, r.n_chars, r.edited_text) for r in made) == Counter(w[:3] for w in want)
        alone = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(docs).collect()}
        assert {(r.doc_id, r.fingerprint) for r in made} == alone
        by_text = {}
        for r in made:
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
            by_text.setdefault(r.edited_text, r.edited_fingerprint)
            assert by_text[r.edited_text] == r.edited_fingerprint
    assert fingerprints.compare_edited(docs.limit(0)).collect() == []
    one = fingerprints.compare_edited(documents(spark, [(1, "a b c d")])).collect()
    assert [(r.edited_text, r.near_next) for r in one] == [("a b a b", 1.0)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_document_of_odd_ids(spark, kind):
    rng = random.Random(14)
    ids = [2**60 + i for i in range(1, 9)] + [-(2**60), -3, 0, 2**63 - 1, -(2**63)] + [None] * 200 + [5] * 150
    rows = [(i, "".join(rng.choices("aé\n b", k=rng.randint(0, 40)))) for i in ids]
    rng.shuffle(rows)
    docs = documents(spark, rows).repartition(5)
    if kind == "string":
        docs, rows = docs.withColumn("doc_id", F.col("doc_id").cast("string")), [(i if i is None else str(i), t) for i, t in rows]
    # The order of the ids as such; rows of one id by text.
    order = sorted(rows, key=lambda r: r[1])
    order = sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    want = Counter()
    for (doc_id, text), (_, after) in zip(order, [*order[1:], *order[:1]]):
        want[doc_id, text[: len(text) - len(text) // 2] + after[: len(text) // 2]] += 1
    original, fingerprints.with_next.__defaults__ = fingerprints.with_next.__defaults__, (200,)
    try:
        made = fingerprints.compare_edited(docs).collect()
        runs = fingerprints.with_next(docs, "doc_id", "text").filter("doc_id IS NULL AND place = 0")
        assert kind == "string" or runs.select("run").distinct().count() > 3
    finally:
        fingerprints.with_next.__defaults__ = original
    assert Counter((r.doc_id, r.edited_text) for r in made) == want


def test_fingerprint_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made = {r.doc_id: r for r in registered.op10_fingerprints(spark, sf).collect()}
    texts, errors = dict(rows), []
    for doc_id, n, text, after in edited(rows):
        r = made[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        errors += [r.near_edited - jaccard(texts[doc_id], text), r.near_next - jaccard(texts[doc_id], after)]
    assert len(made) == len(rows) and np.std(errors) < 0.08
