"""Document fingerprints by consistent weighted sampling.

A document is its words, each weighted by its count. For every sample k and term t, two gamma and
one uniform variate, fixed by a hash of (k, t), decide at which quantised weight the term is
active and how early; the earliest term and its weight level are the sample. Two documents share
sample k with a probability equal to their generalised Jaccard similarity, sum of the smaller
over sum of the larger weights.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from seriesframe.llm.arrow import map_arrow, text_chunks, texts_of

SAMPLES = 64
# Terms whose draws are kept, and terms that are looked up at once.
_MOST_TERMS, _TOGETHER = 120_000, 20_000
_MOST_RUNS = 10_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _variates(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, log c, beta) by term and sample: r and c are gamma(2, 1), beta is uniform.

    A gamma(2, 1) variate is minus the log of a product of two uniforms. Five uniforms of 32 or 24
    bits come out of three mixed 64-bit words.
    """
    seeds = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = _mixed(terms[:, None] ^ seeds[None, :])
    second = _mixed(first + np.uint64(0x632BE59BD9B4E019))
    third = _mixed(second + np.uint64(0x632BE59BD9B4E019))

    def halves(words):
        low = (words & np.uint64(0xFFFFFFFF)).astype(np.float32)
        high = (words >> np.uint64(32)).astype(np.float32)
        return (low + 1) / np.float32(2**32 + 512), (high + 1) / np.float32(2**32 + 512)

    (u1, u2), (u3, u4) = halves(first), halves(second)
    beta = (third >> np.uint64(40)).astype(np.float32) / np.float32(2**24)
    return -np.log(u1 * u2), np.log(-np.log(u3 * u4)), beta


class Sampler:
    """Signatures of bags of terms; what a term and its count come to is computed once and kept."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.early = np.empty((0, samples), np.float32)
        self.level = np.empty((0, samples), np.float32)
        self.terms = np.empty(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        # Row of each term and count; a new one gets the next row.
        self.index: dict[tuple[str, int], int] = defaultdict(count().__next__)

    def term(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        return zlib.crc32(data) | (zlib.adler32(data[::-1]) ^ len(data) * 0x9E3779B1 & 0xFFFFFFFF) << 32

    def _places(self, bags: list[list[tuple[str, int]]]) -> list[np.ndarray]:
        """Rows of the terms of each bag in ``early``, ``level`` and ``terms``, new terms added."""
        index, known = self.index, len(self.index)
        at = [np.fromiter(map(index.__getitem__, bag), np.int64, len(bag)) for bag in bags]
        if len(index) > len(self.early):
            for name in ("early", "level", "terms"):
                old = getattr(self, name)
                new = np.empty((max(len(index), 2 * len(old)), *old.shape[1:]), old.dtype)
                new[:known] = old[:known]
                setattr(self, name, new)
        pairs = list(islice(reversed(index), len(index) - known))[::-1]
        terms = np.array([self.term(word) for word, _ in pairs], np.uint64)
        self.terms[known : len(index)] = terms
        logs = np.log(np.array([n for _, n in pairs], np.float32))
        for lo in range(0, len(pairs), 4096):
            hi = min(lo + 4096, len(pairs))
            r, log_c, beta = _variates(terms[lo:hi], self.samples)
            level = np.floor(logs[lo:hi, None] / r + beta)
            self.early[known + lo : known + hi] = log_c - r * (level - beta) - r
            self.level[known + lo : known + hi] = level
        return at

    def _marks(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The samples that terms of these rows make in these columns."""
        level = self.level[rows, columns].astype(np.int64).astype(np.uint64)
        return _mixed(self.terms[rows] + level * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

    def signatures(self, bags: list[Counter]) -> np.ndarray:
        """One row of 32-bit samples per bag; an empty bag has all zeros.

        Bags share their terms' draws, some bags at a time; a bag of very many terms is taken in parts.
        """
        out = np.zeros((len(bags), self.samples), np.uint32)
        first = np.full((len(bags), self.samples), np.inf, np.float32)
        columns = np.arange(self.samples)
        group: list[tuple[int, list]] = []

        def take() -> None:
            if len(self.index) + sum(len(pairs) for _, pairs in group) > _MOST_TERMS:
                self._forget()
            for (row, _), own in zip(group, self._places([pairs for _, pairs in group])):
                early = self.early[own]
                best = early.argmin(0)
                least = early[best, columns]
                won = least < first[row]
                first[row, won], out[row, won] = least[won], self._marks(own[best], columns)[won]
            group.clear()

        for row, bag in enumerate(bags):
            pairs = list(bag.items())
            for at in range(0, len(pairs), _TOGETHER):
                group.append((row, pairs[at : at + _TOGETHER]))
                if sum(len(own) for _, own in group) >= _TOGETHER:
                    take()
        take()
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per document: id and fingerprint, 8 hexadecimal digits per sample.

    A null text counts as empty; texts without words share one fingerprint of zeros and are alike.
    Equal texts have equal fingerprints, whatever else is in the table.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sample(batches):
        sampler = Sampler(samples)
        for rows, own in text_chunks(batches):
            made = sampler.signatures([Counter((t or "").split()) for t in own])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([to_text(m) for m in made], pa.string())],
                ["doc_id", "fingerprint"],
            )

    made = map_arrow(texts, sample, f"doc_id {kind}, fingerprint string")
    return made.withColumnRenamed("doc_id", id_col)


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _constant(values: list, kind: str) -> Column:
    """An array literal of any length, which Spark evaluates once."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def _place(bounds: Column, number: int, value: Column, equal: bool) -> Column:
    """How many of the sorted ``bounds`` are smaller than ``value``, or not larger: a search by halves."""

    def step(found: Column, more: Column) -> Column:
        bound = F.get(bounds, found + more - 1)
        return F.when(F.coalesce((bound <= value) if equal else (bound < value), F.lit(False)), found + more).otherwise(found)

    steps = [1 << k for k in range(number.bit_length() - 1, -1, -1)] or [1]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _head(text: Column) -> Column:
    """The first bytes of a text as a number, in the order of the texts."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str, chars_per_run: int = 2_000_000) -> DataFrame:
    """Rows dealt into runs of ids, so that the row after each row stands below it in its partition.

    Columns: doc_id, text, order, run, place (0: a row of the run, 1: the first row of the run after
    it). Order: highest id first, in the id's own type, null ids last, rows of one id by text; the
    first row follows the last. Runs are cut at quantiles of the ids; an id with very many
    rows, or the rows without one, also at quantiles of the texts' first bytes. Their number,
    at most ``_MOST_RUNS``, is what the driver holds, and no window or task spans the table.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        order, name, lowest = F.col("doc_id").cast("long"), "long", -(1 << 63)
    elif isinstance(kind, NumericType):
        order, name, lowest = F.col("doc_id").cast("double"), "double", float("-inf")
    else:
        order, name, lowest = _head(F.col("doc_id").cast("string")), "long", -(1 << 63)
    texts = texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({
        "order": F.coalesce(order, F.lit(lowest)), "head": _head(F.col("text")),
    })
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    number = int(min(_MOST_RUNS, max(1, -(-chars // chars_per_run))))

    def quantiles(rows: DataFrame, column: str, number: int) -> list:
        shares = [k / number for k in range(1, number)]
        return sorted((rows.agg(F.percentile_approx(column, shares, 10_000)).first()[0] if shares else None) or [])

    cuts = quantiles(texts, "order", number)
    bounds = _constant(cuts, name)
    texts = texts.withColumns({
        "below": _place(bounds, len(cuts), F.col("order"), False), "upto": _place(bounds, len(cuts), F.col("order"), True)
    })
    # An id that is several quantiles has as many runs, if only rows of that id have its order.
    several, part = F.lit(False), F.lit(0)
    if isinstance(kind, NumericType) and len(set(cuts)) < len(cuts):
        # The smallest id may share its order with rows without an id; it comes before them all.
        alone = F.col("doc_id").isNull() | (F.col("order") != F.lit(lowest))
        several = (F.col("upto") > F.col("below") + 1) & alone
        heads = quantiles(texts.filter(several), "head", 256)
        at = _place(_constant(heads, "long"), len(heads), F.col("head"), True)
        part = F.floor(at * (F.col("upto") - F.col("below")) / F.lit(len(heads) + 1)).cast("int")
    texts = texts.withColumn("run", F.lit(len(cuts)) - F.col("upto") + F.when(several, part).otherwise(F.lit(0)))
    first = F.struct("order", F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("head")).alias("less"))
    tops = texts.groupBy("run").agg(F.max(first).alias("top")).select("run", "top.doc_id", -F.col("top.less")).collect()
    tops.sort(key=lambda row: row["run"])
    before = [row["run"] for row in (tops[-1:] + tops[:-1])]
    of_runs = docs.sparkSession.createDataFrame(
        [(*row, last) for row, last in zip(tops, before)],
        f"run int, top_id {kind.simpleString()}, top_head long, before int",
    )
    is_top = (F.col("head") == F.col("top_head")) & F.col("doc_id").eqNullSafe(F.col("top_id"))
    own = F.struct(F.col("run").alias("run"), F.lit(0).alias("place"))
    copy = F.struct(F.col("before").alias("run"), F.lit(1).alias("place"))
    dealt = texts.join(F.broadcast(of_runs), "run").select(  # one row per run
        "doc_id", "text", "order", F.explode(F.when(is_top, F.array(own, copy)).otherwise(F.array(own))).alias("at")
    )
    return dealt.select("doc_id", "text", "order", "at.run", "at.place")


def compare_edited(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last half of the characters, rounded down, gives way to as many first characters
    of the next document, highest id first (all if it has fewer); the last one's next is the first.
    Columns: id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty; a null id comes last; rows of one id follow each other by text.
    Repeated rows are rows each.
    """
    dealt = with_next(docs, id_col, text_col)
    kind = dealt.schema["doc_id"].dataType.simpleString()
    sorted_rows = dealt.repartition("run").sortWithinPartitions(
        "run", "place", F.col("order").desc(), F.col("doc_id").desc_nulls_last(), "text"
    ).select("doc_id", "text", "run", "place")

    def compare(batches):
        sampler = Sampler(samples)
        held = None  # the last row, whose next row was not known yet

        def bag(text: str) -> Counter:
            return Counter(text.split())

        for rows, texts in text_chunks(batches):
            own = list(zip(rows.column("doc_id").to_pylist(), texts, rows.column("place").to_pylist()))
            met = ([held[0]] if held else []) + own
            edited = [
                text[: len(text) - len(text) // 2] + after[: len(text) // 2]
                for (_, text, _), (_, after, _) in zip(met, met[1:])
            ]
            # Edited texts stand next to the texts that they are made of: their terms' draws are at hand.
            late = len(own) - len(edited)  # 1, unless a row is held: the first row's edited text is yet to come
            bags = [bag(own[0][1])] if late else []
            for (_, text, _), other in zip(own[late:], edited):
                bags += [bag(text), bag(other)]
            made = sampler.signatures(bags)
            signed = np.concatenate([held[1][None] if held else made[:1], made[late::2]])
            changed = made[late + 1 :: 2]
            held = met[-1], signed[-1]
            kept = [i for i in range(len(edited)) if met[i][2] == 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([met[i][0] for i in kept], rows.schema.field("doc_id").type),
                 pa.array([len(met[i][1]) for i in kept], pa.int64()),
                 pa.array([edited[i] for i in kept], pa.string()),
                 pa.array([to_text(signed[i]) for i in kept], pa.string()),
                 pa.array([to_text(changed[i]) for i in kept], pa.string()),
                 pa.array([likeness(signed[i], changed[i]) for i in kept], pa.float64()),
                 pa.array([likeness(signed[i], signed[i + 1]) for i in kept], pa.float64())],
                names,
            )

    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    made = map_arrow(
        sorted_rows, compare,
        f"doc_id {kind}, n_chars long, edited_text string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
    return made.withColumnRenamed("doc_id", id_col)
