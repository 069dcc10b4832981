from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import documents
from seriesframe.llm import components, lines, neardup, registered
from seriesframe.session import materialize


def classes_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(14)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    made = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in made} == classes_of(edges, {x for e in edges for x in e})
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_join_few_rows(spark, monkeypatch):
    """All turns together go over few more edges than there are; a chain and a dense group are one class each."""
    written = []

    def counting(df, label):
        kept = materialize(df, label)
        written.append((label, kept.count()))
        return kept

    monkeypatch.setattr(components, "materialize", counting)
    dense = [(1000 + a, 1000 + b) for a in range(8) for b in range(a + 1, 300)]
    edges = [(k, k + 1) for k in range(300)] + dense + [(5000, 5000)]
    made = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(300)} | {5000: 5000}
    assert {r.node: r.label for r in made} == want and len(made) == len(want)
    assert sum(n for label, n in written if label == "edges") < 1.5 * len(edges)



def weighted(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_similarity(a, b):
    a, b = weighted((a or "").split()), weighted((b or "").split())
    if not a or not b:
        return 0.0
    keys = a.keys() | b.keys()
    probability = sum(
        1 / sum(max(a[k] / a[d], b[k] / b[d]) for k in keys) for d in a.keys() & b.keys()
    )
    return max(probability, len(a.keys() & b.keys()) / len(keys))


def near_copies(rng, n=60):
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(None, "null id"), (1000, None), (1001, ""), (1002, "  "), (1003, "one"), (1004, "one")]
    for i in range(n):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        rows.append((i, " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((2000 + 10 * i + k, " ".join(copy)))
    return rows + rows[10:14]


def test_near_duplicates_against_all_pairs(spark):
    rows = near_copies(random.Random(15))
    docs = documents(spark, rows, {"node": "x", "label": "y", "bands": "z", "nd_key": "k"})
    made = neardup.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in made) == Counter(r[0] for r in rows)
    texts = sorted({t or "" for _, t in rows})
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if plain_similarity(a, b) >= 0.8]
    of = classes_of(links, texts)
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[of[text or ""]].append(doc_id)
    first = {c: min((i for i in own if i is not None), default=None) for c, own in ids.items()}
    want = Counter((i, first[of[t or ""]], len(ids[of[t or ""]])) for i, t in rows)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in made) == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(first.values())
    assert neardup.near_duplicates(docs.limit(0)).collect() == [] == neardup.keep_one(docs.limit(0)).collect()


def test_large_group_of_near_copies(spark, monkeypatch):
    """Star turns first; a chain of copies that only its neighbours link is still one class."""
    monkeypatch.setattr(neardup, "_ROOM_PER_MEMBER", 0.1)
    rng = random.Random(16)
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(120):
        copy = list(words)
        copy[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    chain = [f"c{i}" for i in range(160)]
    rows += [(500 + i, " ".join(chain[2 * i : 2 * i + 80])) for i in range(40)]
    made = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert {made[i] for i in range(120)} == {0} and {made[500 + i] for i in range(40)} == {500}


def repeated_passages(rng):
    """(id, text): pairs that only plain Jaccard links, and one group of them, beside loose texts."""
    vocabulary, rows = [f"r{i}" for i in range(5000)], []
    for i, (length, block, times) in enumerate([(100, 40, 10), (504, 54, 12), (504, 54, 12), (100, 40, 20)] * 3):
        base = rng.choices(vocabulary, k=length)
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join(base[:block] * times + base[block:])))
    base = rng.choices(vocabulary, k=100)
    for i in range(24):
        at = rng.randrange(60)
        rows.append((500 + i, " ".join(base[:at] + base[at : at + 40] * rng.randint(1, 12) + base[at + 40 :])))
    return rows + [(1000 + i, " ".join(rng.choices(vocabulary, k=80))) for i in range(20)]


def test_repeated_passages_against_all_pairs(spark, monkeypatch):
    """Plain Jaccard links are found in star turns and in blocks."""
    rows = repeated_passages(random.Random(23))
    texts = sorted({t for _, t in rows})
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if plain_similarity(a, b) >= 0.8]
    of, first = classes_of(links, texts), {}
    for i, t in rows:
        first[of[t]] = min(first.get(of[t], i), i)
    want = {i: first[of[t]] for i, t in rows}
    assert [want[i] for i in range(0, 24)] == [i - i % 2 for i in range(24)]
    for room, block in ((4, 500), (0, 500), (10**9, 7)):
        monkeypatch.setattr(neardup, "_ROOM_PER_MEMBER", room)
        monkeypatch.setattr(neardup, "BLOCK", block)
        made = neardup.near_duplicates(documents(spark, rows)).collect()
        assert {r.doc_id: r.class_id for r in made} == want


def test_signatures_agree_as_probability_jaccard():
    rng, errors = random.Random(17), []
    for turn in range(80):
        keys = np.array(rng.sample(range(1, 2**62), rng.randint(1, 60)), np.uint64)
        sets = []
        for _ in range(2):
            own = np.array([rng.random() < 0.8 for _ in keys])
            own[0] = True
            sets.append((np.sort(keys[own]), np.array([rng.choice([1, 1, 2, 9]) for _ in range(own.sum())])))
        a, b = neardup.signatures(sets, 256)
        errors.append((a == b).mean() - neardup.similarities(*sets)[0])
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.04


def test_similarities_against_the_definition():
    rng, shingler = random.Random(18), neardup.Shingler()
    for _ in range(200):
        a, b = (" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(2))
        assert abs(max(neardup.similarities(shingler(a), shingler(b))) - plain_similarity(a, b)) < 1e-9


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        change = rng.choice("ids")
        if change == "i":
            text.insert(at, rng.choice("abé😀"))
        elif at < len(text):
            text[at : at + 1] = [] if change == "d" else [rng.choice("abé😀")]
    return "".join(text)


def test_edit_distance(spark):
    rng, rows = random.Random(19), []
    for _ in range(2000):
        a = "".join(rng.choices("ab😀é", k=rng.randint(8, 26)))
        rows.append((a, mutated(rng, a, rng.randint(0, 5))))
    for edits in (1, 2, 3):
        fit = [(a, b) for a, b in rows if abs(len(a) - len(b)) <= edits < min(len(a), len(b))]
        made = spark.createDataFrame(fit, "a string, b string").select(
            "a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("near")).collect()
        assert all(r.near == (levenshtein(r.a, r.b) <= edits) for r in made) and len(made) == len(fit)


def line_rows(rng):
    bases = ["".join(rng.choices("abcdef ", k=rng.randint(24, 60))).replace("  ", "a ") for _ in range(25)]
    rows = [(None, bases[0]), (900, None), (901, ""), (902, "\n\n"), (903, "short\nshort"), (904, "y" * 100_000 + "\n" + "y" * 99_999)]
    for i in range(80):
        own = [mutated(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.8 else "brief" for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(own)))
    return rows + [rows[20]]


def test_lines_against_all_pairs(spark):
    rows = line_rows(random.Random(20))
    docs = documents(spark, rows, {"line": "x", "line_id": "y", "gone": "z", "first": "f", "ld_text": "t"})
    made = lines.line_classes(docs).collect()
    long_lines = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(x) >= 24]
    texts = sorted({x for _, _, x in long_lines})
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= 2
             and (len(a) < 1000 and levenshtein(a, b) <= 2 or len(a) > 1000)]
    of = classes_of(links, texts)
    firsts = {}
    for i, k, x in long_lines:
        place = (i is None, i or 0, k)
        firsts[of[x]] = min(firsts.get(of[x], place), place)
    want = Counter((i, k, firsts[of[x]] == (i is None, i or 0, k)) for i, k, x in long_lines)
    assert Counter((r.doc_id, r.line_no, r.first) for r in made) == want
    by_class, own = defaultdict(set), {(i, k): of[x] for i, k, x in long_lines}
    for r in made:
        by_class[r.class_id].add(own[r.doc_id, r.line_no])
    assert all(len(v) == 1 for v in by_class.values()) and len(by_class) == len(set(of.values()))

    gone = {(i, k) for i, k, first in want if not first}
    kept = []
    for doc_id, text in rows:
        own_lines = (text or "").split("\n")
        left = [x for k, x in enumerate(own_lines) if (doc_id, k) not in gone]
        if len(left) == len(own_lines):
            kept.append((doc_id, text))
        elif "".join(left).strip():
            kept.append((doc_id, "\n".join(left)))
    dropped = lines.drop_repeated(docs)
    assert dropped.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in dropped.collect()) == Counter(kept)
    assert lines.line_classes(docs.limit(0)).collect() == [] == lines.drop_repeated(docs.limit(0)).collect()


def test_every_line_that_is_not_blank_takes_part(spark, tmp_path):
    rng = random.Random(24)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 14))) for _ in range(40)]
    rows = [(900, None), (901, ""), (902, " \n\t\n"), (903, "All rights reserved.\nLes.\nLet."), (904, "All rights reserved!\n\nLes.")]
    for i in range(60):
        own = [rng.choice(["", " ", mutated(rng, rng.choice(words), rng.choice([0, 0, 0, 1, 2]))]) for _ in range(5)]
        rows.append((i, "\n".join(own)))
    every = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in every})
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i]
             if min(len(a), len(b)) >= 6 and levenshtein(a, b) <= 2]
    of, firsts = classes_of(links, texts), {}
    for i, k, x in every:
        firsts[of[x]] = min(firsts.get(of[x], (i, k)), (i, k))
    want = {(i, k): firsts[of[x]] == (i, k) for i, k, x in every}
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    made = registered.QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert len(made) == len(want) and {(r.doc_id, r.line_no): r.first for r in made} == want
    by_class, own = defaultdict(set), {(i, k): of[x] for i, k, x in every}
    for r in made:
        by_class[r.class_id].add(own[r.doc_id, r.line_no])
    assert all(len(v) == 1 for v in by_class.values()) and len(by_class) == len(set(of.values()))
    kept = corpus_pipeline.line_dedup(spark, documents(spark, rows), str(tmp_path))
    left = {r.doc_id: r.text for r in kept.filter("doc_id >= 903").collect()}
    assert left == {903: "All rights reserved.\nLes.\nLet."}


def test_lines_of_rows_that_share_an_id(spark):
    """Several null ids, and one id with different texts: each row loses its own repeats only."""
    def line(k):
        return f"{k} " + chr(97 + k) * 30

    known = [(1, line(0))]
    shared = [line(0) + "\n" + line(1), line(2) + "\n" + line(3), line(4) + "\n" + line(5), line(4) + "\n" + line(6)]
    alone = [line(10 + k) + "\n" + line(0) for k in range(8)]
    for key in (None, 7):
        rows = known + [(key, t) for t in shared + alone + [alone[0]]]
        docs = documents(spark, rows)
        made = sorted((r.doc_id or 0, r.text) for r in lines.drop_repeated(docs).collect())
        texts = [t for i, t in made if i == (key or 0)]
        of = Counter(x for t in set(texts) for x in t.split("\n"))
        assert (1, line(0)) in made and len(made) == len(rows)
        assert of == Counter(line(k) for k in (*range(1, 7), *range(10, 18)))
        assert texts.count(line(10)) == 2 and shared[1] in texts
        first = [r for r in lines.line_classes(docs).collect() if r.first]
        assert len(first) == 16


def common_lines(rng):
    """Lines of three common segments: all near each other, a chain, and lines that are mostly far apart."""
    starts = ["".join(rng.choices("abcdefgh ", k=40)) + ":" for _ in range(3)]
    base = "".join(rng.choices("ijkl", k=26))
    near = {base[:k] + c + base[k + 1 :] for k in range(26) for c in "mnopqrstuvwx"}
    chain = ["x" * 2 * k + "y" * (80 - 2 * k) for k in range(41)]
    apart = [base[:k] + "".join(rng.choices("стуab", k=3)) + base[k:] for k in range(27) for _ in range(2)]
    return starts, sorted(near), chain, sorted(set(apart))


def test_lines_of_common_segments_against_all_pairs(spark):
    starts, near, chain, apart = common_lines(random.Random(31))
    for hubs, room in ((lines.HUBS, lines.ROOM_PER_LINE), (1, 0)):  # the second goes on with turns while they help
        of_lines = [starts[0] + t for t in near[::7]] + [starts[1] + t for t in chain] + [starts[2] + t for t in apart]
        links = [(a, b) for i, a in enumerate(of_lines) for b in of_lines[:i]
                 if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2]
        of, own = classes_of(links, of_lines), dict(enumerate(of_lines))
        assert len({of[x] for x in of_lines[: len(near[::7]) + len(chain)]}) == 2 and len(set(of.values())) > 20
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lines, "HUBS", hubs)
            patch.setattr(lines, "ROOM_PER_LINE", room)
            made = lines.line_classes(documents(spark, list(own.items()))).collect()
        by_class = defaultdict(set)
        for r in made:
            by_class[r.class_id].add(of[own[r.doc_id]])
        assert len(made) == len(own) and all(len(v) == 1 for v in by_class.values())
        assert len(by_class) == len(set(of.values()))


def test_lines_of_a_common_segment_are_not_all_paired(spark, monkeypatch):
    """Twice as many lines that are all near each other: at most about twice as many pairs, not four times."""
    tested, real = Counter(), lines.materialize

    def counted(df, label):
        made = real(df, label)
        if label in ("line-pairs", "line-star", "line-rest"):
            tested[len(rows)] += made.count()
        return made

    monkeypatch.setattr(lines, "materialize", counted)
    starts, near, _, _ = common_lines(random.Random(32))
    for n in (140, 280):
        rows = list(enumerate(starts[0] + t for t in near[:n]))
        made = lines.line_classes(documents(spark, rows)).collect()
        assert len(made) == n and len({r.class_id for r in made}) == 1
    assert 0 < tested[280] <= 2.5 * tested[140] and tested[280] < 280 * 16


def test_line_dedup_is_native(spark):
    docs = documents(spark, line_rows(random.Random(21)))
    for made in (lines.line_classes(docs), lines.drop_repeated(docs), lines.edit_links(lines.lines_of(docs))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_probes_cover_every_shift():
    """Any two strings within the threshold share a probed segment."""
    rng = random.Random(22)
    for edits in (1, 2, 3):
        for _ in range(400):
            a = "".join(rng.choices("ab", k=rng.randint(8, 20)))
            b = mutated(rng, a, rng.randint(0, edits))
            a, b = sorted((a, b), key=len)
            delta, parts = len(b) - len(a), edits + 1
            if delta > edits or levenshtein(a, b) > edits or len(a) < 8:
                continue
            size, rest = divmod(len(a), parts)
            starts = [size * p + max(0, rest + p - parts) for p in range(parts)]
            widths = [size + (rest + p - parts >= 0) for p in range(parts)]
            assert any(d == delta and a[starts[p] : starts[p] + widths[p]] == b[starts[p] + s : starts[p] + s + widths[p]]
                       for d, p, s in lines.probes(edits) if starts[p] + s >= 0)


def test_letter_counts_keep_near_lines(spark):
    """Lines within the edits pass whatever their lengths; lines alike at one end only do not."""
    rng = random.Random(21)

    def some(n):
        return "".join(rng.choices("etaonird é", k=n))

    def edited(line):
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(line))
            line = line[:at] + some(rng.randint(0, 2))[:1] + line[at + rng.randint(0, 1) :]
        return line

    rows = [(a, edited(a), True) for a in (some(rng.choice([6, 63, 64, 65, 66, 130, 400])) for _ in range(300))]
    ends = [some(200) for _ in range(4)]
    rows += [(ends[0] + ends[1], ends[0] + ends[2], False), (ends[1] + ends[0], ends[2] + ends[0], False)]
    # Counts of whole lines agree here, those of the ends do not.
    rows += [("eta" * 22 + "oni" * 22 + ends[3], "oni" * 22 + "eta" * 22 + ends[3], False)]
    pairs = spark.createDataFrame(rows, "a string, b string, want boolean").select(
        "want", lines.letter_counts(F.col("a")).alias("x"), lines.letter_counts(F.col("b")).alias("y")
    )
    near = pairs.select("want", lines._letters_near(F.col("x"), F.col("y"), 2).alias("near"))
    assert near.filter("want <> near").count() == 0
