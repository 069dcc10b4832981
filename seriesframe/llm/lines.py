"""Line de-duplication by a segment-partition edit join, in DataFrame expressions only.

Two lines within ``edits`` edits share one of the ``edits + 1`` segments of the shorter line, at a
place that the edits before and after it can have moved it to. Every line is indexed by its
segments, keyed by length, segment number and content, and probes, for each length that a partner
can have, the substrings at those places. Candidates are verified by a banded bit-parallel edit
distance: one fold over a line's characters with the band's vertical differences in two integers.
Lines that share a segment with very many others are not paired with all of them: some of them are
tested against the rest, and only pairs of lines that this leaves in different components follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.bits import among
from seriesframe.llm.components import components
from seriesframe.session import materialize

EDITS = 2
MIN_CHARS = 24
# With this as ``min_chars``, every line that is not blank takes part.
ALL_LINES = 1
# Letters whose counts in so many characters at either end of a line tell most candidates apart before
# the edit distance is computed.
COUNTED, END_CHARS = "etaonird", 64
# Characters whose counts in whole lines are compared, for lines that are candidates only.
COUNTED_WHOLE = "etaonirdshlucmfw", "gypbvkxjqz .,012"
# A segment of more lines than this is common: its lines are not joined with each other at once.
COMMON = 32
# Lines of a common segment that the others are tested against in one turn.
HUBS = 2
# Pairs left open for each line of a common segment up to which they are all tested.
ROOM_PER_LINE = 16


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(_text(text_col))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash, which with the id names the text), line_no (from 0), line, chars and
    line_id (a 64-bit hash) of every line."""
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), _text_key(text_col).alias("text_key"), _text(text_col).alias("text")
    )
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumns({"chars": F.length("line"), "line_id": F.xxhash64("line")})


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the partner is, segment, shift of its start) of every probe."""
    return [
        (delta, segment, shift)
        for delta in range(edits + 1)
        for segment in range(edits + 1)
        for shift in range(
            max(-segment, delta - (edits - segment)), min(segment, delta + (edits - segment)) + 1
        )
    ]


def segment_keys(edits: int) -> tuple[Column, Column]:
    """(index keys, probe keys) of a row with ``line`` and ``chars``: arrays of hashes."""

    def key(delta, segment, shift):
        length, parts = F.col("chars") - delta, edits + 1
        size = (length / parts).cast("int")
        longer = length % parts + segment - parts
        start = size * segment + F.greatest(longer, F.lit(0)) + shift
        width = size + F.when(longer >= 0, 1).otherwise(0)
        return F.xxhash64(length, F.lit(segment), F.substring("line", start + 1, width))

    return (
        F.array(*(key(0, segment, 0) for segment in range(edits + 1))),
        F.array(*(key(*probe) for probe in probes(edits))),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _bits(value: int) -> Column:
    return F.lit(value).cast("long")


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance in characters, exact up to ``edits``; a larger one comes out larger than that.

    ``a`` and ``b`` are arrays of characters, longer than ``edits`` and at most ``edits`` apart in
    length. Column j of the distance matrix lives in the band of rows j - edits .. j + edits: bit k
    of vp (vn) says that the distance rises (falls) from the row above to row j - edits + k. The
    distance d follows the band's lower edge and, once that passes the last row, the last row.
    """
    width = 2 * edits + 1
    full = _bits((1 << width) - 1)

    def flip(bits: Column) -> Column:
        return F.bitwise_not(bits).bitwiseAND(full)

    def matches(j: Column) -> Column:
        char = F.get(b, j - 1)
        found = _bits(0)
        for k in range(width):
            same = F.coalesce(F.get(a, j - edits + k - 1) == char, F.lit(False))
            found = found + F.when(same, _bits(1 << k)).otherwise(_bits(0))
        return found

    def advance(state: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def with_diagonal(zero: Column) -> Column:
            across = F.struct(
                vn.bitwiseOR(flip(zero.bitwiseOR(vp))).alias("up"), zero.bitwiseAND(vp).alias("down"),
                F.shiftright(zero, 1).alias("next"),
            )
            return _let(across, lambda h: finish(zero, h))

        def finish(zero: Column, h: Column) -> Column:
            at = (F.size(a) - j + edits).cast("int")
            one = _bits(1)
            edge = one - F.shiftright(zero, 2 * edits).bitwiseAND(one)
            row = F.call_function("shiftright", h["up"], at).bitwiseAND(one) - F.call_function(
                "shiftright", h["down"], at
            ).bitwiseAND(one)
            return F.struct(
                h["down"].bitwiseOR(flip(h["next"].bitwiseOR(h["up"]))).alias("vp"),
                h["next"].bitwiseAND(h["up"]).alias("vn"),
                (state["d"] + F.when(j + edits <= F.size(a), edge).otherwise(row)).alias("d"),
            )

        return _let(matches(j), lambda pm: _let(
            (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full),
            with_diagonal,
        ))

    start = F.struct(
        _bits(((1 << width) - 1) & ~((1 << edits) - 1)).alias("vp"), _bits(0).alias("vn"),
        _bits(edits).alias("d"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, advance, lambda s: s["d"])


def _shared(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common prefix, at most ``most``: a search by halves."""
    def search(of: Column) -> Column:
        def longer(length: Column, step: Column) -> Column:
            fits = (length + step <= of["most"]) & (
                F.substring(of["a"], length + 1, step) == F.substring(of["b"], length + 1, step)
            )
            return F.when(fits, length + step).otherwise(length)

        return F.aggregate(F.array(*(F.lit(1 << k) for k in range(24, -1, -1))), F.lit(0), longer)

    return _let(F.struct(a.alias("a"), b.alias("b"), most.alias("most")), search)


def _ends_fit(a: Column, b: Column, ends: Column, edits: int) -> Column:
    """False only for lines more than ``edits`` apart. Between the common start and end, the first and
    the last step of an alignment are edits; if these are all, what lies between them is equal."""
    rest_a, rest_b = (F.length(line) - ends["prefix"] - ends["suffix"] for line in (a, b))
    fit = F.greatest(rest_a, rest_b) <= edits
    if edits > 2:
        return F.lit(True)
    steps = [(1, 1), (1, 0), (0, 1)] if edits == 2 else []
    for first_a, first_b in steps:
        for last_a, last_b in steps:
            size = rest_a - first_a - last_a
            fit = fit | (
                (size == rest_b - first_b - last_b) & (size > 0)
                & (F.substring(a, ends["prefix"] + first_a + 1, size) == F.substring(b, ends["prefix"] + first_b + 1, size))
            )
    return fit


def _cores(a: Column, b: Column, edits: int) -> Column:
    """The two lines without their common start and end, but for ``edits`` + 1 characters each, and
    whether they fit at these."""
    keep = edits + 1
    shorter = F.least(F.length(a), F.length(b))

    def cut(ends: Column) -> Column:
        start, end = (F.greatest(ends[n] - keep, F.lit(0)) for n in ("prefix", "suffix"))
        return F.struct(*(
            F.substring(line, start + 1, F.length(line) - start - end).alias(name)
            for line, name in ((a, "a"), (b, "b"))
        ), _ends_fit(a, b, ends, edits).alias("fit"))

    def with_suffix(prefix: Column) -> Column:
        suffix = _shared(F.reverse(a), F.reverse(b), shorter - prefix)
        return _let(F.struct(prefix.alias("prefix"), suffix.alias("suffix")), cut)

    return _let(_shared(a, b, shorter), with_suffix)


def within(a: Column, b: Column, edits: int) -> Column:
    """True if two lines are at most ``edits`` apart; their characters are taken out once."""
    def characters(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit("(?s)."), 0)

    return _let(_cores(a, b, edits), lambda core: core["fit"] & _let(
        F.struct(characters(core["a"]).alias("a"), characters(core["b"]).alias("b")),
        lambda pair: edit_distance(pair["a"], pair["b"], edits) <= edits,
    ))


def _packed_counts(letters: list[tuple[Column, str]]) -> Column:
    """How often each letter is in its text, modulo 16, four bits each."""
    packed = _bits(0)
    for k, (text, letter) in enumerate(letters):
        count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(F.pmod(count, F.lit(16)).cast("long"), 4 * k))
    return packed


def letter_counts(line: Column) -> Column:
    """Counts of the letters in ``COUNTED`` at the line's start, then at its end, modulo 16, four bits
    each: the cost of a line is bounded, and a segment that two lines share hides one end at most."""
    ends = F.substring(line, 1, END_CHARS), F.substring(line, -END_CHARS, END_CHARS)
    return _packed_counts([(end, letter) for end in ends for letter in COUNTED])


def whole_counts(line: Column) -> Column:
    """Counts of the characters in ``COUNTED_WHOLE`` in the whole line, packed as in :func:`letter_counts`."""
    return F.array(*(_packed_counts([(line, letter) for letter in some]) for some in COUNTED_WHOLE))


def _gaps(x: Column, y: Column) -> Column:
    """Differences between the sixteen packed counts of two lines, added up in pairs to eight bytes;
    modulo 16 they are never too large. Few operations, as they run for every pair that meets."""
    def of_half(shift: int) -> Column:
        own, other = (F.shiftrightunsigned(c, shift).bitwiseAND(_bits(0x0F0F0F0F0F0F0F0F)) for c in (x, y))
        gap = (own + _bits(0x1010101010101010) - other).bitwiseAND(_bits(0x0F0F0F0F0F0F0F0F))
        over = F.shiftrightunsigned(gap, 3).bitwiseAND(_bits(0x0101010101010101))  # 8 and more: 16 less the gap
        return gap.bitwiseXOR(over * 15) + over

    return of_half(0) + of_half(4)


def _letters_near(x: Column, y: Column, edits: int) -> Column:
    """False only for lines more than ``edits`` apart: an edit changes two counts of an end by one at
    most, as the character that it moves over the end's border is one of the two."""
    gaps = _gaps(x, y)
    # A number modulo 255 is the sum of its bytes, if that is smaller.
    ends = gaps.bitwiseAND(_bits(0xFFFFFFFF)), F.shiftrightunsigned(gaps, 32)
    return (ends[0] % 255 <= 2 * edits) & (ends[1] % 255 <= 2 * edits)


def _whole_near(x: Column, y: Column, edits: int) -> Column:
    """The same for counts of whole lines."""
    first, second = (_gaps(F.get(x, F.lit(k)), F.get(y, F.lit(k))) % 255 for k in range(len(COUNTED_WHOLE)))
    return (first <= 2 * edits) & (first + second <= 2 * edits)


def _count_keys(key: Column, whole: Column, edits: int) -> Column:
    """An array of hashes of ``key`` and the counts of some characters. Two lines within ``edits`` edits
    and with the same ``key`` share one: the characters are in 2 * edits + 1 lots, and 2 * edits counts
    differ at most."""
    lots, hashes = 2 * edits + 1, []
    for lot in range(lots):
        some = [
            F.shiftrightunsigned(F.get(whole, F.lit(k)), 4 * n).bitwiseAND(_bits(15))
            for k, letters in enumerate(COUNTED_WHOLE) for n in range(len(letters)) if n % lots == lot
        ]
        hashes.append(F.xxhash64(key, F.lit(lot), *some))
    return F.array(*hashes)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def line_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(line_id, index, probe, letters), one row per different line: its segments, the substrings that
    it probes, and its letter counts. Tasks combine their own copies of a line first."""
    index, probe = segment_keys(edits)
    keys = lines.select(
        "line_id", index.alias("index"), probe.alias("probe"),
        letter_counts(F.col("line")).alias("letters"),
    )
    return keys.groupBy("line_id").agg(*(F.first(c).alias(c) for c in ("index", "probe", "letters")))


def common_segments(once: DataFrame) -> DataFrame:
    """(key): the segments that more than ``COMMON`` lines have."""
    sizes = once.select(F.explode("index").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return sizes.filter(F.col("n") > COMMON).select("key")


def candidates(once: DataFrame, common: DataFrame, edits: int) -> DataFrame:
    """(a, b), a < b: ids of different lines that share a segment within the allowed shift, other than
    a common one, and whose letter counts do not rule it out."""
    left = once.select(F.col("line_id").alias("x"), F.col("letters").alias("lx"), F.explode("index").alias("key"))
    right = once.select(F.col("line_id").alias("y"), F.col("letters").alias("ly"), F.explode("probe").alias("key"))
    near = _letters_near(F.col("lx"), F.col("ly"), edits)
    pairs = left.join(common, "key", "left_anti").join(right, "key").filter((F.col("x") != F.col("y")) & near)
    return pairs.select(*_ordered("x", "y")).distinct()


def common_members(once: DataFrame, common: DataFrame) -> DataFrame:
    """(key, line_id, own): the lines that have a common segment (own) or only probe it."""
    every = once.select("line_id", "index", F.explode(F.array_distinct("probe")).alias("key"))
    members = every.join(common, "key", "left_semi")
    return members.select("key", "line_id", F.array_contains("index", F.col("key")).alias("own"))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of lines at most ``edits`` apart."""
    one, two = (
        texts.select(F.col("line_id").alias(of), F.col("line").alias(f"l{of}"), F.col("whole").alias(f"w{of}"))
        for of in ("a", "b")
    )
    hopeful = (F.abs(F.length("la") - F.length("lb")) <= edits) & _whole_near(F.col("wa"), F.col("wb"), edits)
    near = pairs.join(one, "a").join(two, "b").filter(hopeful)
    return near.filter(within(F.col("la"), F.col("lb"), edits)).select("a", "b")


def _open_pairs(placed: DataFrame) -> tuple[int, int]:
    """(pairs of one common segment but two components, rows of such segments)."""
    by_label = placed.groupBy("key", "label").agg(
        F.count("*").cast("double").alias("n"), F.count_if("own").cast("double").alias("own")
    )
    sums = by_label.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum(F.col("n") * F.col("own")).alias("closed")
    ).withColumn("open", F.col("n") * F.col("own") - F.col("closed"))
    row = sums.filter("open > 0").agg(F.sum("open"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _star(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): some lines of each common segment with its lines that are in other components."""
    drawn = [
        F.min_by(
            F.struct(F.col("line_id").alias("y"), F.col("label").alias("ly")),
            F.when(F.col("own"), F.xxhash64("line_id", F.lit(turn * HUBS + k))),
        )
        for k in range(HUBS)
    ]
    hubs = placed.groupBy("key").agg(F.array(*drawn).alias("hubs"))
    met = placed.join(hubs, "key").withColumn("hub", F.explode("hubs")).filter("hub.ly <> label")
    return met.select(F.col("line_id").alias("x"), "hub.y").select(*_ordered("x", "y")).distinct()


def _rest(placed: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(a, b): all pairs of lines of one common segment but two components whose letter counts do not
    rule them out. One of the two is outside the segment's largest component, so that the lines
    of that are not compared with each other; they meet by the counts of some letters."""
    largest = placed.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest")
    )
    keyed = placed.join(largest, "key").join(texts.select("line_id", "whole"), "line_id").select(
        "line_id", "label", "own", "whole", (F.col("label") != F.col("largest")).alias("outside"),
        F.explode(_count_keys(F.col("key"), F.col("whole"), edits)).alias("meet"),
    )
    one = keyed.filter("outside").select(
        "meet", F.col("line_id").alias("x"), F.col("label").alias("lx"), F.col("own").alias("ox"), F.col("whole").alias("wx")
    )
    two = keyed.select(
        "meet", F.col("line_id").alias("y"), F.col("label").alias("ly"), F.col("own").alias("oy"), F.col("whole").alias("wy")
    )
    pairs = one.join(two, "meet").filter(
        (F.col("lx") != F.col("ly")) & (F.col("ox") | F.col("oy")) & _whole_near(F.col("wx"), F.col("wy"), edits)
    )
    return pairs.select(*_ordered("x", "y")).distinct()


def _common_links(members: DataFrame, texts: DataFrame, links: DataFrame, edits: int) -> DataFrame:
    """``links`` and as many more as join all lines of common segments that links join.

    A few lines of each segment are tested against its lines in other components, turn by turn. When
    few pairs are left between components, or another turn would not halve them, they are all tested:
    no link between two components is left out.
    """
    turn, before = 0, None
    while True:
        labels = components(links).withColumnRenamed("node", "line_id")
        placed = members.join(labels, "line_id", "left").withColumn("label", F.coalesce("label", "line_id"))
        placed = materialize(placed, "line-placed")
        pairs, rows = _open_pairs(placed)
        if pairs <= ROOM_PER_LINE * rows or before is not None and pairs > before / 2:
            break
        found = _verified(materialize(_star(placed, turn), "line-star"), texts, edits)
        links = materialize(links.union(found), "line-links")
        before, turn = pairs, turn + 1
    if pairs:
        found = _verified(materialize(_rest(placed, texts, edits), "line-rest"), texts, edits)
        links = materialize(links.union(found), "line-links")
    return links


def edit_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): ids of different lines at most ``edits`` apart; any two such lines are linked, or joined
    by links that go through other lines.

    Only candidates' texts are shuffled, once per line and end of a pair.
    """
    once = materialize(line_keys(lines, edits), "line-keys")
    common = materialize(common_segments(once), "line-common")
    pairs = materialize(candidates(once, common, edits), "line-pairs")
    members = None if common.isEmpty() else materialize(common_members(once, common), "line-members")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("line_id"))
    ids = materialize((ids.union(members.select("line_id")) if members else ids).distinct(), "line-ids")
    # An inner join with distinct ids: a semi join would be moved before the bit table.
    wanted = among(lines, ids, "line_id").join(ids, "line_id")
    texts = wanted.groupBy("line_id").agg(F.first("line").alias("line"))
    texts = materialize(texts.withColumn("whole", whole_counts(F.col("line"))), "line-texts")
    links = _verified(pairs, texts, edits)
    return _common_links(members, texts, materialize(links, "line-links"), edits) if members else links


def line_classes(
    docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: doc_id, line_no, line_id, class_id
    and first (true for the line of the class with the smallest document id and number).

    Lines are in one class if equal or joined by links of at most ``edits`` edits; such links are
    between lines of more than 2 * ``edits`` + 1 characters, shorter ones are compared for equality.
    Blank lines are left out where ``min_chars`` is that small. Null and empty
    texts have no such lines; a null id comes last; of different texts under one id, or without an
    id, the hash of the text decides between equal line numbers; rows alike in id, text and line
    number are first together. Lines are known by a 64-bit hash.
    """
    return _placed(docs, edits, min_chars, id_col, text_col).drop("text_key")


def _placed(docs: DataFrame, edits: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`line_classes` with their text_key."""
    lines = lines_of(docs, id_col, text_col).filter(F.col("chars") >= min_chars)
    if min_chars <= 2 * edits + 1:
        lines = lines.filter(F.col("line").rlike(r"\S"))
    long_lines = lines.filter(F.col("chars") > 2 * edits + 1)
    labels = components(edit_links(long_lines, edits)).withColumnRenamed("node", "line_id")
    placed = lines.select("doc_id", "text_key", "line_no", "line_id").join(labels, "line_id", "left").select(
        "doc_id", "text_key", "line_no", "line_id", F.coalesce("label", "line_id").alias("class_id")
    )
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("line_no"), F.col("text_key"))
    firsts = placed.groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    several = firsts.filter("n > 1").select("class_id", "first")
    joined = placed.join(several, "class_id", "left")
    return joined.select(
        "doc_id", "text_key", "line_no", "line_id", "class_id",
        (F.col("first").isNull() | (F.col("first") == place)).alias("first"),
    )


def drop_repeated(
    docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with all columns, each class of lines kept at its first place only.

    Lines shorter than ``min_chars`` stay. A document that loses all its lines but blank ones is
    left out; one that loses none is returned as it was. Rows without an id, or with one id and
    different texts, are documents of their own.
    """
    classes = _placed(docs, edits, min_chars, id_col, text_col)
    repeats = classes.filter(~F.col("first")).groupBy("doc_id", "text_key").agg(
        F.collect_set("line_no").alias("gone")
    )
    repeats = materialize(
        repeats.select(F.col("doc_id").alias("of_id"), "text_key", F.array_sort("gone").alias("gone")), "repeats"
    )
    # Rows travel as one struct, so that their columns cannot clash with these.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
        _text_key(text_col).alias("text_key"), F.col(f"`{text_col}`").alias("text"),
    )
    marked = rows.join(
        repeats.withColumnRenamed("text_key", "of_key"),
        F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left",
    )
    pieces = F.split(F.col("text").cast("string"), "\n")
    # Runs between dropped lines: linear in the lines, where a search per line would not be.
    ends = F.concat(F.col("gone"), F.array(F.size(pieces)))
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1))
    runs = F.flatten(F.zip_with(begins, ends, lambda x, y: F.slice(pieces, x + 1, F.greatest(y - x, F.lit(0)))))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(runs, "\n"))
    out = marked.withColumn("kept", kept).filter(
        F.col("gone").isNull() | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != "")
    )
    return out.select(*(
        F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns
    ))
