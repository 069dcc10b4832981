"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of three letters binds its letters'
vectors, each permuted by its place: roll(a, 2) * roll(b, 1) * c. A language's prototype is the
bundle (sum) of the n-grams of its documents, and a document goes to the prototype with the
largest cosine. Sums are linear, so a document's product with a prototype is the sum of its n-grams'
products, which are computed once per distinct n-gram and not once per character.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow, text_chunks, texts_of

DIMENSIONS = 4096
UNDETERMINED = "und"
_CACHED_NGRAMS = 500_000
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=20_000)
def _letter_vector(code_point: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([seed, code_point])).integers(0, 2, dimensions)
    return (2 * bits - 1).astype(np.int8)


def ngram_vectors(ngrams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """One bound vector per n-gram key."""
    rows = np.empty((len(ngrams), dimensions), np.float32)
    for row, key in zip(rows, ngrams.tolist()):
        a, b, c = (_letter_vector(key >> s & 0x1FFFFF, dimensions, seed) for s in (42, 21, 0))
        np.multiply(np.roll(a, 2) * np.roll(b, 1), c, out=row, casting="unsafe")
    return rows


def ngrams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, number of the text each is from), in the order of the texts.

    Letters are lower-cased, everything else is a space and runs of spaces are one. N-grams have
    a letter in the middle, so none spans two words or two texts.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) + 1 for t in lowered], np.int64)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)]).astype(np.int32)
    codes = np.where(_letters()[codes], codes, _SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    middle = codes[1:-1] != _SPACE
    keys = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    return keys[middle], owner[1:-1][middle]


@dataclass(frozen=True)
class Profiles:
    """Prototype vectors by language."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    seed: int

    @property
    def dimensions(self) -> int:
        return self.prototypes.shape[1]


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    dimensions: int = DIMENSIONS, seed: int = 7,
) -> Profiles:
    """Prototypes from all rows with a language and a text.

    Each task bundles its own documents and sends one vector per language; Spark sums them. What
    reaches the driver is one vector per distinct language. No labelled row: no languages.
    """
    rows = docs.select(
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).dropna()

    def bundle(batches):
        counts: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, own in counts.items():
                keys, number = np.array(list(own), np.uint64), np.array(list(own.values()), np.float64)
                total = sums.setdefault(lang, np.zeros(dimensions))
                for at in range(0, len(keys), 1000):
                    total += number[at : at + 1000] @ ngram_vectors(keys[at : at + 1000], dimensions, seed)
            counts.clear()

        for chunk, texts in text_chunks(batches):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts, chunk.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                held = counts.setdefault(lang, {})
                for key, n in zip(*(x.tolist() for x in np.unique(ngrams_of(own)[0], return_counts=True))):
                    held[key] = held.get(key, 0) + n
            if sum(map(len, counts.values())) > _CACHED_NGRAMS:
                flush()
        flush()
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * dimensions, "at": np.arange(dimensions, dtype=np.int32), "part": total}
            )

    summed = (
        map_arrow(rows, bundle, "lang string, at int, part double")
        .groupBy("lang", "at").agg(F.sum("part").alias("total"))
    )
    found: dict[str, np.ndarray] = {}
    for row in summed.collect():
        found.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["total"]
    languages = tuple(sorted(found))
    matrix = np.array([found[lang] for lang in languages]).reshape(len(languages), dimensions)
    return Profiles(languages, matrix.astype(np.float32), seed)


class Scorer:
    """Cosines of texts with every prototype."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        norms = np.linalg.norm(profiles.prototypes, axis=1, keepdims=True)
        self.unit = profiles.prototypes / np.maximum(norms, 1e-12)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.products = np.zeros((0, len(self.profiles.languages)), np.float32)

    def _products(self, keys: np.ndarray) -> np.ndarray:
        """Products of n-grams (sorted, distinct) with the prototypes."""
        if len(self.keys) > _CACHED_NGRAMS:
            self.clear()
        new = keys[~np.isin(keys, self.keys, assume_unique=True)]
        if len(new):
            made = [
                ngram_vectors(new[at : at + 1000], self.profiles.dimensions, self.profiles.seed) @ self.unit.T
                for at in range(0, len(new), 1000)
            ]
            keys_now = np.concatenate([self.keys, new])
            order = np.argsort(keys_now)
            self.keys, self.products = keys_now[order], np.concatenate([self.products, *made])[order]
        return self.products[np.searchsorted(self.keys, keys)]

    def cosines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cosine by text and language, texts that have a letter).

        The length of a document's vector is taken as sqrt(D * sum of squared n-gram counts), its
        length when distinct n-grams are orthogonal, as random vectors are up to a relative error
        of about sqrt(2 / D). It scales a text's cosines alike and does not touch their order.
        """
        n, languages = len(texts), len(self.profiles.languages)
        keys, owner = ngrams_of(texts)
        distinct, index = np.unique(keys, return_inverse=True)
        pairs, counts = np.unique(owner.astype(np.int64) * max(1, len(distinct)) + index, return_counts=True)
        of, which = np.divmod(pairs, max(1, len(distinct)))
        products = self._products(distinct)[which] * counts[:, None]
        sums = np.zeros((n, languages))
        for k in range(languages):
            sums[:, k] = np.bincount(of, products[:, k], minlength=n)
        squares = np.bincount(of, counts.astype(float) ** 2, minlength=n)
        lengths = np.sqrt(self.profiles.dimensions * squares)
        return sums / np.maximum(lengths, 1e-12)[:, None], squares > 0


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred and score, the cosine cut to 0..1.

    A null text, a text without letters and any text under empty profiles is ``und`` with score 0.
    Of equally close languages the first by name wins. The prototypes travel with the tasks; their
    size is languages times dimensions.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def score(batches):
        scorer = Scorer(profiles)
        names = np.array([*profiles.languages, UNDETERMINED], object)
        for rows, own in text_chunks(batches):
            cosines, lettered = scorer.cosines(own)
            best = np.full(len(own), len(profiles.languages))
            value = np.zeros(len(own))
            if len(profiles.languages):
                best = np.where(lettered, cosines.argmax(1), best)
                value = np.where(lettered, cosines.max(1).clip(0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(names[best], pa.string()), pa.array(value, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    made = map_arrow(texts, score, f"doc_id {kind}, lang_pred string, score double")
    return made.withColumnRenamed("doc_id", id_col)


def held_out(id_col: str = "doc_id"):
    """True for documents that profiles must not learn from: crc32 of the id as text mod 3 is 1."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1
