"""Quality rules: counted facts of a text and a calibrated n-gram classifier.

The classifier is a logistic regression on the relative frequencies of hashed words and hashed
character trigrams. It is fitted on a bounded sample of labelled rows, its margins are turned into
probabilities on a held-out part of that sample, and it is applied in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import hash_share, map_arrow, text_chunks, texts_of

BITS = 15
BUCKETS = 1 << BITS
SCALE = 30.0
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = 0.5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


class _Hashes(dict):
    """Word (bytes) -> its 64-bit hash, computed once while the table lasts."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = zlib.crc32(word) | zlib.adler32(word[::-1]) << 32
        return value


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of five words found twice or more, its first place included."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows = _mixed(windows * _MIX + hashes[k : k + n])
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    marks = np.zeros(len(hashes) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    places = np.flatnonzero(again)
    marks[places] += 1
    marks[places + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def facts(text: str | None, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    lines = [line for line in text.split("\n") if _SPACES.sub("", line)] if "\n" in text else []
    return (
        len(hashes), len(text) - len(_SPACES.findall(text)), len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)), repeated_words(hashes),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _char_buckets(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    keys = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    return (keys * _MIX >> np.uint64(64 - BITS)).astype(np.int64) + BUCKETS


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): scaled shares of hashed words and of hashed character trigrams."""
    parts = []
    for buckets in (_word_buckets(hashes), _char_buckets(text or "")):
        found, counts = np.unique(buckets, return_counts=True)
        parts.append((found, SCALE * counts / max(1, len(buckets))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass(frozen=True)
class QualityModel:
    """Weights of the buckets, and slope and offset that turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, text: str | None, hashes: np.ndarray) -> float:
        total = self.bias
        for buckets in (_word_buckets(hashes), _char_buckets(text or "")):
            if len(buckets):
                total += SCALE * float(self.weights[buckets].sum()) / len(buckets)
        return total

    def probability(self, text: str | None, hashes: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text, hashes) + self.offset, -50, 50))))


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, ridge: float, steps: int):
    """Logistic regression by accelerated gradient steps on sparse rows."""
    index = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    squares = np.bincount(owner, values**2, minlength=len(rows))
    rate = 4 / (squares.max(initial=1) + 1 + 4 * ridge)
    weights, bias = np.zeros(2 * BUCKETS), 0.0
    ahead, ahead_bias, pace = weights, bias, 1.0
    for _ in range(steps):
        margin = np.bincount(owner, ahead[index] * values, minlength=len(rows)) + ahead_bias
        error = (1 / (1 + np.exp(-margin)) - wanted) / len(rows)
        gradient = np.bincount(index, values * error[owner], minlength=2 * BUCKETS) + ridge * ahead
        new, new_bias = ahead - rate * gradient, ahead_bias - rate * error.sum()
        pace_now = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / pace_now
        ahead, ahead_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias, pace = new, new_bias, pace_now
    return weights, float(bias)


def _calibrated(margins: np.ndarray, wanted: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out margins, by Newton steps."""
    positive = wanted.sum()
    target = np.where(wanted > 0, (positive + 1) / (positive + 2), 1 / (len(wanted) - positive + 2))
    design = np.column_stack([margins, np.ones(len(margins))])
    found = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * (found - [1.0, 0.0]))
        found = found - np.clip(step, -1, 1)
    return (float(found[0]), float(found[1])) if found[0] > 0 else (1.0, 0.0)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 4000, ridge: float = 1e-5, steps: int = 300,
) -> QualityModel:
    """Fit on about ``max_rows`` labelled rows, drawn by a hash of the id; four fifths fit the
    weights and the rest the calibration.

    ``labels`` has the id and ``quality`` (0 or 1); rows with a null are left out, of several rows
    for one id the lowest quality holds. Hashed features reach the driver, no text does. Without
    both kinds of label the model calls everything good.
    """
    known = labels.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col("quality").cast("double").alias("wanted")
    ).dropna().groupBy("doc_id").agg(F.min("wanted").alias("wanted"))
    number = known.count()
    drawn = known.filter(hash_share("doc_id", min(1.0, max_rows / max(1, number))))
    rows = texts_of(docs, id_col, text_col).join(drawn, "doc_id")

    def hashed(batches):
        for chunk, texts in text_chunks(batches):
            table = _Hashes()
            made = [features(t, np.array([table[w] for w in words_of(t)], np.uint64)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").cast(pa.string()), chunk.column("wanted"),
                 pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                 pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))],
                ["doc_id", "wanted", "buckets", "shares"],
            )

    table = map_arrow(
        rows, hashed, "doc_id string, wanted double, buckets array<int>, shares array<float>"
    ).toArrow().sort_by("doc_id")
    wanted = table.column("wanted").to_numpy()
    if len(set(wanted.tolist())) < 2:
        return QualityModel(np.zeros(2 * BUCKETS, np.float32), 0.0, 1.0, 50.0)
    sparse = [
        (b.values.to_numpy(), s.values.to_numpy().astype(float))
        for b, s in zip(table.column("buckets"), table.column("shares"))
    ]
    held = np.array([zlib.crc32(i.encode()) % 5 == 0 for i in table.column("doc_id").to_pylist()])
    if len(set(wanted[~held].tolist())) < 2 or not held.any():
        held[:] = False
    weights, bias = _fit([r for r, h in zip(sparse, held) if not h], wanted[~held], ridge, steps)
    slope, offset = 1.0, 0.0
    if held.any():
        margins = np.array([weights[b] @ v + bias for (b, v), h in zip(sparse, held) if h])
        slope, offset = _calibrated(margins, wanted[held])
    return QualityModel(weights.astype(np.float32), bias, slope, offset)


def apply_rules(
    docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality (the calibrated probability) and kept.

    A null text counts as empty, and an empty one fails the base rules. Repeated rows stay. Equal
    windows are found by a 64-bit hash of five words. The model is a fixed number of weights.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()

    def judge(batches):
        table = _Hashes()
        for chunk, own in text_chunks(batches):
            if len(table) > 1_000_000:
                table.clear()
            rows = []
            for text in own:
                hashes = np.array([*map(table.__getitem__, words_of(text))], np.uint64)
                counted = facts(text, hashes)
                failed = base_failed(counted[0], counted[4])
                good = model.probability(text, hashes)
                rows.append((*counted, failed, good, not failed and good >= threshold))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), *(pa.array([r[i] for r in rows]) for i in range(8))],
                ["doc_id", *columns, "base_failed", "quality", "kept"],
            )

    made = map_arrow(
        texts, judge,
        f"doc_id {kind}, " + ", ".join(f"{c} long" for c in columns)
        + ", base_failed boolean, quality double, kept boolean",
    )
    return made.withColumnRenamed("doc_id", id_col)
