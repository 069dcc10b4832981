"""Spelling variants of a corpus' words by permuterm rotations.

A word with an end mark has one rotation per character and one for the mark. Turned so that the
edited character c comes last, a word a + c + b reads b, mark, a, c: all words that replace c start
with the same prefix b, mark, a, and the word a + b, without c, has a rotation that is this prefix.
So with every rotation listed once whole and once without its last character, and all of them
sorted, the words one edit apart stand next to each other. A scan over the sorted rotations meets
groups that hold at most one row per letter of the alphabet and one more; from each group a member
takes the number of its neighbours and the most frequent one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow, text_chunks
from seriesframe.session import materialize

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
# Sorts before every letter and occurs in no word.
END = "\x01"
_RUN = re.compile("[a-zÀ-ÿ]+")
_HELD_WORDS = 200_000


def word_counts(
    docs: DataFrame, misspell: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, n: how often each run of letters (A-Z lower-cased, Latin-1 letters) occurs in all texts.

    With ``misspell`` a fixed share of them loses a letter, as a test of what follows: where that
    number divides the crc32 h of ``<id>:<run>``, the run's character h modulo its length goes. A
    null text has no words, a null id reads as an empty string. Tasks count before the shuffle and
    hold a bounded number of words at a time.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).filter(F.col("text") != "")

    def count(batches):
        held: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        for rows, own in text_chunks(batches):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), own):
                runs = Counter(_RUN.findall(text.encode().lower().decode()))
                if misspell:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run in list(runs):
                        found = zlib.crc32(run.encode(), start)
                        if found % misspell == 0:
                            at = found % len(run)
                            held[run[:at] + run[at + 1 :]] += runs.pop(run)
                held.update(runs)
                if len(held) > _HELD_WORDS:
                    yield sent()
                    held.clear()
        yield sent()

    counted = map_arrow(texts, count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("word") != "")


def rotations(words: DataFrame) -> DataFrame:
    """prefix, last, word, n, opens: the rotations of ``words`` (word, n), whole (``last`` empty)
    and without the last character, which is ``last``.

    ``opens`` is false for a character like the one before it in the word: leaving out either of
    them gives the same word, which counts once.
    """
    length = F.length("word")
    turn = F.concat(F.expr("substring(word, at + 1)"), F.lit(END), F.expr("substring(word, 1, at)"))
    whole = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("at")).select(
        turn.alias("prefix"), F.lit("").alias("last"), "word", "n", F.lit(True).alias("opens")
    )
    skipped = words.select("word", "n", F.explode(F.sequence(F.lit(1), length)).alias("at")).select(
        F.concat(F.expr("substring(word, at + 1)"), F.lit(END), F.expr("substring(word, 1, at - 1)")).alias("prefix"),
        F.expr("substring(word, at, 1)").alias("last"), "word", "n",
        ((F.col("at") == 1) | (F.expr("substring(word, at, 1)") != F.expr("substring(word, at - 1, 1)"))).alias("opens"),
    )
    return whole.union(skipped)


def _scan(rows: list[tuple[str, str, int, bool]]) -> list[tuple[str, int, int, str]]:
    """(word, neighbours in this group, n of the most frequent one, that one) of each member that has
    any; rows are (last, word, n, opens) of one prefix."""
    skipped = [r for r in rows if r[0]]
    whole = next((r for r in rows if not r[0]), None)
    ranked = sorted(rows, key=lambda r: (-r[2], r[1]))[:2]
    found = []
    for last, word, _, opens in rows:
        near = len(skipped) - 1 + bool(whole and opens) if last else sum(r[3] for r in skipped)
        best = ranked[ranked[0][1] == word]
        found.append((word, near, best[2], best[1]))
    return found


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, n_near and the near word of largest n (ties: the smallest) with its n, for all words.

    Words are near if one inserted, deleted or replaced character makes one of the other. No pair
    is a row: each member of a group of equal prefixes sends one row. ``words`` holds each once.
    """
    names = ["word", "near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    ordered = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix", "last")

    def bounds(rows: pa.RecordBatch) -> list[int]:
        prefix = rows.column("prefix")
        changes = pc.indices_nonzero(pc.not_equal(prefix[1:], prefix[:-1])).to_numpy() + 1
        return [0, *changes.tolist(), len(rows)]

    def found_in(rows: pa.RecordBatch) -> pa.RecordBatch:
        cuts, found = bounds(rows), []
        for begin, end in zip(cuts, cuts[1:]):
            if end - begin > 1:
                group = rows.slice(begin, end - begin)
                found += _scan(list(zip(*(group.column(c).to_pylist() for c in ("last", "word", "n", "opens")))))
        columns = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def scan(batches):
        tail = None  # the rows of the last prefix, which the next batch may go on with
        for batch in batches:
            rows = batch if tail is None else pa.concat_batches([tail, batch])
            if len(rows):
                last = bounds(rows)[-2]
                yield found_in(rows.slice(0, last))
                tail = rows.slice(last)
        if tail is not None:
            yield found_in(tail)

    found = map_arrow(ordered, scan, "word string, near long, best_n long, best string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"),
                        F.lit(None).cast("string").alias("best"))
    every = none.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    return every.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("top")
    ).select("word", "n", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain word, form, its form and so on, for rows (word, form).

    Every turn doubles the steps taken; a chain is short, as each form is several times as frequent.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(links.join(ahead, "root", "left"), "roots")
        links = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.filter("further IS NOT NULL").isEmpty():
            return links


def variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO,
    misspell: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, form, root (strings), n, n_near, form_n of every word of at least ``min_chars``
    characters that occurs at least ``min_count`` times.

    ``form`` is the near word of largest n (ties: the smallest) if that is at least ``ratio`` times
    the word's own n, else null; ``root`` follows forms to the last, and is the word itself where
    there is none. Repeated rows count each; null and empty texts add nothing, an empty table gives
    no rows, further columns are not read.
    """
    words = materialize(
        word_counts(docs, misspell, id_col, text_col).filter(
            (F.length("word") >= min_chars) & (F.col("n") >= min_count)
        ),
        "words",
    )
    holds = F.col("best_n") >= ratio * F.col("n")
    near = materialize(
        neighbours(words).select(
            "word", "n", "n_near", F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")
        ),
        "near-words",
    )
    ends = roots(near.filter("form IS NOT NULL"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
