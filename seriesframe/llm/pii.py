"""Personal data: fixed patterns, and contexts bootstrapped from what these find.

The fixed patterns give the seed entities. The words in front of an entity are its lexical
patterns. Spark keeps the graph of patterns and the instances that follow them, counts how
often each pattern occurs at all, and scores both sides in turn: a pattern is as good as the
share of its occurrences that precede good instances, an instance as good as its patterns together.
Instances of well-shaped but unmatched text behind good patterns become new entities, and these induce
patterns in the next round.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow, text_chunks, texts_of
from seriesframe.session import materialize

KINDS = ("email", "ip", "card", "phone")
CONTEXT_WORDS = 2
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
FILTER_BITS = 22

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
# Digit groups with brackets, dots and hyphens, joined by single spaces; each ends its word.
_SPACED = re.compile(r"\(?[0-9][0-9().-]*+(?=[\s\"'>\]},;:!?]|$)(?:\x20\(?[0-9][0-9().-]*+(?=[\s\"'>\]},;:!?]|$))+")


def _emails(text: str):
    """Local part, ``@``, domain with a dot: leftmost matches, found from each ``@`` outwards."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            floor = found.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(floor, at + 1))


def _ips(text: str):
    """Four groups of a chain of digits and dots at a time; parts above 255 drop the match."""
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".")
        begin = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield begin, end
            begin = end + 1


def _luhn(digits: str) -> bool:
    double = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


def _cards(text: str):
    for found in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", found[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str):
    for found in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", found[0])) <= 15:
            yield found.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind; ends are exclusive, in code points."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return found
    if "@" in text:
        found += ((a, b, 0) for a, b in _emails(text))
    if _DIGIT.search(text):
        found += ((a, b, 1) for a, b in _ips(text))
        found += ((a, b, 2) for a, b in _cards(text))
        if "+" in text:
            found += ((a, b, 3) for a, b in _phones(text))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def shapes_of(form: str) -> list[int]:
    """Kinds that an unmatched piece of text could be of, by its characters alone."""
    digits = sum(c.isdigit() for c in form)
    kinds = []
    if "@" in form or "(at)" in form or "[at]" in form:
        kinds.append(0)
    if digits >= 4 and form.count(".") + form.count(":") >= 3:
        kinds.append(1)
    if 12 <= digits <= 19 and digits >= 0.8 * len(form):
        kinds.append(2)
    if 7 <= digits <= 15 and digits >= 0.6 * len(form):
        kinds.append(3)
    return kinds


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces outside ``taken`` that have the shape of some kind: words with a digit or ``@``, of any
    length, and runs of digit groups that single spaces join, if the first group alone has no shape."""
    found, floor, tried, spans, k = [], 0, 0, sorted(taken), 0
    for sign in _SIGN.finditer(text):
        if sign.start() < floor:
            continue
        begin = sign.start()
        while begin > floor and not text[begin - 1].isspace():
            begin -= 1
        end = sign.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        floor, word = end, begin
        while begin < end and text[begin] in "\"'<([{=,;:.!?":
            begin += 1
        while end > begin and text[end - 1] in "\"'>)]}=,;:.!?":
            end -= 1
        kinds = shapes_of(text[begin:end])
        if not kinds and begin >= tried:
            run = _SPACED.match(text, begin - (begin > word and text[begin - 1] == "("))
            if run:
                # Words within a run that is too long do not begin another one: the scan stays linear.
                tried = run.end()
                whole = run[0].rstrip(".-(")
                kinds = shapes_of(whole)
                if kinds:
                    begin, end = run.start(), run.start() + len(whole)
                    floor = max(floor, end)
        while k < len(spans) and spans[k][1] <= begin:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        found += ((begin, end, kind) for kind in kinds)
    return found


def _word_hash(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))


def _patterns(hashes: list[int]) -> list[int]:
    """The patterns that a run of word hashes ends with: its last word, its last two, ..."""
    value, found = 0, []
    for depth, word in enumerate(reversed(hashes[-CONTEXT_WORDS:]), 1):
        value = (value * 0x9E3779B97F4A7C15 + word * 0xBF58476D1CE4E5B9 + depth) & 0x7FFFFFFFFFFFFFFF
        found.append(value)
    return found


def contexts(text: str, start: int) -> list[int]:
    """Patterns of the words in front of ``start``, however long they are."""
    end, words = start, []
    while end and text[end - 1] in "\"'(<[{":
        end -= 1
    if end and not text[end - 1].isspace():
        return []
    while len(words) < CONTEXT_WORDS:
        while end and text[end - 1].isspace():
            end -= 1
        if not end:
            break
        begin = end
        while begin and not text[begin - 1].isspace():
            begin -= 1
        words.append(text[begin:end])
        end = begin
    return _patterns([_word_hash(w) for w in reversed(words)])


def _filter_of(patterns: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[patterns & ((1 << FILTER_BITS) - 1)] = True
    return np.packbits(bits)


@dataclass(frozen=True)
class Mentions:
    """What a scan of the texts leaves in the shared folder, one row per document.

    doc_id, text_key (a hash, which with the id names the text), base spans, and mentions: start,
    end, kind, seed (found by a base pattern), form and patterns.
    """

    rows: DataFrame
    texts: DataFrame


def text_key(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Mentions:
    texts = texts_of(docs, id_col, text_col).withColumn("text_key", text_key())
    kind = texts.schema["doc_id"].dataType.simpleString()

    def find(batches):
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
        mention = pa.struct([
            *span, pa.field("seed", pa.bool_()), pa.field("form", pa.string()),
            pa.field("patterns", pa.list_(pa.int64())),
        ])
        for rows, own in text_chunks(batches):
            bases, mentions = [], []
            for text in own:
                base = base_spans(text)
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                every = [(*s, True) for s in base]
                if text and _SIGN.search(text):
                    every += ((*s, False) for s in candidates(text, base))
                mentions.append([
                    {"start": a, "end": b, "kind": k, "seed": seed, "form": text[a:b].lower(),
                     "patterns": contexts(text, a)}
                    for a, b, k, seed in every
                ])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"),
                 pa.array(bases, pa.list_(span)), pa.array(mentions, pa.list_(mention))],
                ["doc_id", "text_key", "base", "mentions"],
            )

    spans = "array<struct<start:int,end:int,kind:int>>"
    made = map_arrow(
        texts, find,
        f"doc_id {kind}, text_key long, base {spans}, mentions array<struct<start:int,end:int,"
        "kind:int,seed:boolean,form:string,patterns:array<long>>>",
    )
    return Mentions(materialize(made, "mentions"), texts)


def occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, n: how often each of the ``wanted`` patterns occurs in the texts, before anything.

    A bit table of fixed size lets tasks skip other word pairs; a join removes false hits. Tasks add
    up their own hits before the shuffle.
    """
    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)

    def fold(batches):
        own = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            own |= _filter_of(batch.column("pattern").to_numpy())
        yield pa.RecordBatch.from_pydict({"bits": pa.array([own.tobytes()], pa.binary())})

    for row in map_arrow(wanted.coalesce(8), fold, "bits binary").collect():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = wanted.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        table, hits = np.unpackbits(shared.value).astype(bool), {}
        hashes: dict[str, int] = {}
        mask = np.int64((1 << FILTER_BITS) - 1)
        for _, own in text_chunks(batches):
            if len(hashes) > 1_000_000:
                hashes.clear()
            for text in own:
                words = (text or "").split()
                if not words:
                    continue
                for word in words:
                    if word not in hashes:
                        hashes[word] = _word_hash(word)
                numbers = np.array([hashes[w] for w in words], np.uint64)
                value = np.zeros(len(numbers), np.uint64)
                for depth in range(1, CONTEXT_WORDS + 1):
                    value = value[1:] if depth > 1 else value
                    last = numbers[: len(numbers) - depth + 1]
                    value = value * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(depth)
                    value &= np.uint64(0x7FFFFFFFFFFFFFFF)
                    keys = value.astype(np.int64)
                    for key in keys[table[keys & mask]].tolist():
                        hits[key] = hits.get(key, 0) + 1
            if len(hits) > 1_000_000:
                yield _hits(hits)
                hits = {}
        yield _hits(hits)

    found = map_arrow(texts.select("text"), count, "pattern long, n long")
    return found.groupBy("pattern").agg(F.sum("n").alias("n")).join(wanted, "pattern", "left_semi")


def _hits(hits: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(hits), pa.int64()), pa.array(list(hits.values()), pa.int64())], ["pattern", "n"]
    )


def bootstrap(
    mentions: Mentions, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    rounds: int | None = None,
) -> DataFrame:
    """doc_id, text_key, spans: what good patterns find beyond the base patterns.

    Edges join a pattern, a kind and an instance (its lower-cased form), with their number. An instance
    is good from a score of ``min_confidence`` on; seeds have 1. In each round ``min_support`` different
    good instances induce a pattern. Its confidence is the weight of good instances behind it over all
    its occurrences plus one, and an instance's score the noisy-or of its patterns' confidences. What
    became good so induces patterns in the next round. Scores never fall, so this ends: when a round
    brings neither a new pattern nor a new good instance, or after ``rounds``, if given.
    """
    flat = mentions.rows.select("doc_id", "text_key", F.explode("mentions").alias("m")).select(
        "doc_id", "text_key", "m.*"
    )
    edges = materialize(
        flat.select(F.explode("patterns").alias("pattern"), "kind", "form", "seed")
        .groupBy("pattern", "kind", "form").agg(F.count("*").alias("n"), F.max("seed").alias("seed")),
        "edges",
    )
    seeds = edges.groupBy("kind", "form").agg(F.max("seed").cast("double").alias("seed_score"))
    scores = seeds.withColumnRenamed("seed_score", "score")
    good = F.col("score") >= min_confidence
    counted, turn, n_good = None, 0, -1
    while rounds is None or turn < rounds:
        induced = edges.join(scores.filter(good), ["kind", "form"]).groupBy("pattern", "kind").agg(
            F.sum(F.col("score") * F.col("n")).alias("weight"), F.count("*").alias("support")
        ).filter(F.col("support") >= min_support)
        induced = materialize(induced, f"induced-{turn}")
        fresh = induced.select("pattern").distinct()
        if counted is not None:
            fresh = fresh.join(counted, "pattern", "left_anti")
        fresh = materialize(fresh, f"fresh-{turn}")
        grown = not fresh.isEmpty()
        if grown:
            more = materialize(occurrences(mentions.texts, fresh), f"occurrences-{turn}")
            counted = more if counted is None else counted.unionByName(more)
        now = scores.filter(good).count()
        if counted is None or not (grown or now > n_good):
            break
        strong = induced.join(counted, "pattern").select(
            "pattern", "kind", F.least(F.col("weight") / (F.col("n") + 1), F.lit(1.0)).alias("confidence")
        )
        found = edges.join(strong, ["pattern", "kind"]).filter(F.col("confidence") > 0.1).groupBy(
            "kind", "form"
        ).agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))).alias("by_pattern"))
        scores = materialize(
            seeds.join(found, ["kind", "form"], "left").select(
                "kind", "form", F.greatest("seed_score", F.coalesce("by_pattern", F.lit(0.0))).alias("score")
            ),
            f"scores-{turn}",
        )
        turn, n_good = turn + 1, now
    new = flat.filter(~F.col("seed")).join(
        scores.filter(good).select("kind", "form"), ["kind", "form"], "left_semi"
    )
    span = F.struct("start", "end", "kind")
    return new.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, base (spans of the fixed patterns) and spans (all), each an array of
    (start, end, kind name) by start, then kind.

    A null text counts as empty and has no spans. Rows alike in id and text get the same spans. The
    scan's output is written to the shared folder; spans found by bootstrapping are joined to it.
    """
    mentions = scan(docs, id_col, text_col)
    new = bootstrap(mentions, **options)
    rows, more = mentions.rows.alias("r"), new.alias("n")
    joined = rows.join(
        more,
        F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.text_key") == F.col("n.text_key")),
        "left",
    )
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    every = F.concat("base", F.coalesce("spans", empty))
    return joined.select(
        F.col("r.doc_id").alias(id_col), _named(F.col("base")).alias("base"), _named(every).alias("spans")
    )


def _named(spans):
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.transform(
        F.array_sort(order),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), names[s["k"]].alias("kind")),
    )


def written(spans):
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by ``<kind>``; of overlapping spans the first one counts."""
    if not text or not spans:
        return text
    out, at = [], 0
    for begin, end, kind in sorted(spans, key=lambda s: (s[0], s[2])):
        if begin >= at:
            out += [text[at:begin], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, personal data in the text replaced by ``<kind>``.

    The base patterns run again where the text stands, so that only spans beyond them are joined. A null
    text becomes an empty one, as far as it is read; repeated rows stay, masked alike.
    """
    new = bootstrap(scan(docs, id_col, text_col), **options)
    new = materialize(new.select(F.col("doc_id").alias("pii_id"), F.col("text_key").alias("pii_key"), "spans"), "new-spans")
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"),
        F.col(f"`{id_col}`").alias("doc_id"),
    ).withColumn("text_key", text_key())
    joined = whole.join(
        new, F.col("doc_id").eqNullSafe(F.col("pii_id")) & (F.col("text_key") == F.col("pii_key")), "left"
    ).select("row", "text", "spans")

    def apply(batches):
        for rows, own in text_chunks(batches):
            more = rows.column("spans").to_pylist()
            made = [
                mask(t, base_spans(t) + [(s["start"], s["end"], s["kind"]) for s in m or ()])
                for t, m in zip(own, more)
            ]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(made, pa.string())], ["row", "masked"])

    kind = joined.schema["row"].dataType.simpleString()
    made = map_arrow(joined, apply, f"row {kind}, masked string")
    return made.select(*(
        F.col("masked").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
    ))
