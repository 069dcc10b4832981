"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

Labelled rows give every host, and every path below it, a posterior share of good documents. It is
shrunk towards the parent's: a site with few labels has nearly its parent's share. How strongly is
estimated from the spread of the shares themselves. A logistic regression on counted properties
of the text gives each document a log-likelihood ratio, which moves its path's log odds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow, text_chunks
from seriesframe.session import materialize

THRESHOLD = 0.25

PROPERTIES = (
    "upper_share", "symbol_share", "shout_share", "digit_share", "distinct_share", "top_share",
    "repeat_line_share", "log_words",
)
_UPPER = bytes([*range(65, 91), *range(192, 215), *range(216, 223)])  # in Latin-1
_SYMBOL = b"#*$%&|<>{}[]=~^_\\"
_DIGIT = b"0123456789"


def properties_of(text: str | None) -> tuple[float, ...]:
    """Shares of a text's characters, words and lines; all 0 for a text without words."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return (0.0,) * len(PROPERTIES)
    single, counts, n = text.encode("latin-1", "replace"), Counter(words), len(words)

    def share(of: bytes) -> float:
        return 1 - len(single.translate(None, of)) / len(single)

    return (
        share(_UPPER), share(_SYMBOL), share(b"!"), share(_DIGIT),
        (len(counts) / n) ** 0.5 if n > 1 else 1.0, max(counts.values()) / n if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines), math.log(n) / 10,
    )


def measured(docs: DataFrame, text_col: str, **keep: Column) -> DataFrame:
    """The ``keep`` columns of every row and the properties of its text."""
    rows = docs.select(
        F.struct(*(c.alias(name) for name, c in keep.items())).alias("keep"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )

    def measure(batches):
        for chunk, own in text_chunks(batches):
            made = np.array([properties_of(t) for t in own], float).reshape(len(own), len(PROPERTIES))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("keep"), *(pa.array(made[:, i]) for i in range(len(PROPERTIES)))],
                ["keep", *PROPERTIES],
            )

    kind = rows.schema["keep"].dataType.simpleString()
    return map_arrow(rows, measure, f"keep {kind}, " + ", ".join(f"{p} double" for p in PROPERTIES))


@dataclass(frozen=True)
class Evidence:
    """Weights of the standardised properties; the last one is the bias."""

    means: tuple[float, ...]
    spreads: tuple[float, ...]
    weights: tuple[float, ...]
    base_log_odds: float

    def log_ratio(self) -> Column:
        """log P(properties | good) / P(properties | bad)."""
        total = F.lit(self.weights[-1] - self.base_log_odds)
        for name, mean, spread, weight in zip(PROPERTIES, self.means, self.spreads, self.weights):
            total = total + (F.col(name) - mean) / spread * weight
        return total


def fit_evidence(rows: DataFrame, ridge: float = 1.0, steps: int = 12) -> Evidence:
    """Logistic regression of ``good`` (0 or 1) on the properties of all ``rows``.

    Each Newton step is one grouped aggregation of products; only sums come to the driver.
    """
    size = len(PROPERTIES)
    first = rows.agg(
        F.count("*").alias("n"), F.sum("good").alias("good"),
        *(F.avg(p).alias(f"m{i}") for i, p in enumerate(PROPERTIES)),
        *(F.stddev_pop(p).alias(f"s{i}") for i, p in enumerate(PROPERTIES)),
    ).first()
    n, good = first["n"], first["good"] or 0.0
    odds = float(np.log((good + 1) / (n - good + 1)))
    if not n or good in (0, n):
        return Evidence((0.0,) * size, (1.0,) * size, (*(0.0,) * size, odds), odds)
    means = tuple(first[f"m{i}"] for i in range(size))
    spreads = tuple(first[f"s{i}"] or 1.0 for i in range(size))
    design = [(F.col(p) - m) / s for p, m, s in zip(PROPERTIES, means, spreads)] + [F.lit(1.0)]
    weights = np.array([*(0.0,) * size, odds])
    for _ in range(steps):
        margin = sum((x * float(w) for x, w in zip(design, weights)), F.lit(0.0))
        p = 1 / (1 + F.exp(-margin))
        scored = rows.select("good", p.alias("p"), *(x.alias(f"x{i}") for i, x in enumerate(design)))
        sums = scored.agg(
            *(F.sum((F.col("p") - F.col("good")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(size + 1)),
            *(F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}")
              for i in range(size + 1) for j in range(i + 1)),
        ).first()
        hessian = np.array([[sums[f"h{max(i, j)}_{min(i, j)}"] for j in range(size + 1)] for i in range(size + 1)])
        penalty = np.diag([*(ridge,) * size, 0.0])
        gradient = np.array([sums[f"g{i}"] for i in range(size + 1)]) + penalty @ weights
        step = np.linalg.solve(hessian + penalty + 1e-6 * np.eye(size + 1), gradient)
        weights = weights - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return Evidence(means, spreads, tuple(float(w) for w in weights), odds)


def _strength(sites: DataFrame, weakest: float = 2.0, strongest: float = 10_000.0) -> float:
    """Number of labels that a parent's share counts for, by the method of moments.

    ``sites`` has n, good and prior. Shares that spread no more than chance give the strongest
    shrinkage, shares that are all 0 or 1 the weakest.
    """
    spread = (F.col("good") / F.col("n") - F.col("prior")) ** 2 * F.col("n")
    chance = F.col("prior") * (1 - F.col("prior"))
    row = sites.agg(
        F.sum(spread).alias("seen"), F.sum(chance).alias("chance"), F.sum(F.col("n") * chance).alias("whole")
    ).first()
    seen, by_chance, whole = (row[k] or 0.0 for k in ("seen", "chance", "whole"))
    if whole <= by_chance or seen <= by_chance:
        return strongest
    share = (seen - by_chance) / (whole - by_chance)
    return float(np.clip(1 / share - 1, weakest, strongest))


@dataclass(frozen=True)
class SiteModel:
    """Evidence weights, the global share of good documents, and a posterior per host and path."""

    evidence: Evidence
    prior: float
    hosts: DataFrame
    paths: DataFrame

    def score(self, rows: DataFrame, threshold: float) -> DataFrame:
        """Adds evidence, host_posterior, path_posterior, quality and kept to measured rows.

        Sites join on their keys; Spark broadcasts a small table of sites and splits a host that
        holds much of the rows otherwise.
        """
        joined = rows.join(self.hosts, "host", "left").join(self.paths, ["host", "path"], "left")
        host = F.coalesce("host_posterior", F.lit(self.prior))
        path = F.coalesce("path_posterior", host)
        ratio = F.least(F.greatest(self.evidence.log_ratio(), F.lit(-30.0)), F.lit(30.0))
        sited = joined.withColumns(
            {"evidence": ratio, "host_posterior": host, "path_posterior": path}
        )
        odds = F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) + F.col("evidence")
        return sited.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn(
            "kept", F.col("quality") >= threshold
        )


def fit(rows: DataFrame, labels: DataFrame) -> SiteModel:
    """The model from measured rows (doc_id, host, path, properties) and labels of their ids.

    Uses every row whose id has a label. Rows with a null label are left out, of several labels of
    an id the lowest holds. Without labels all priors are 1/2 and the evidence is 0.
    """
    known = labels.select(
        "doc_id", F.least(F.greatest(F.col("quality").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("q")
    ).dropna().groupBy("doc_id").agg(F.min("q").alias("good"))
    labelled = materialize(rows.join(known, "doc_id"), "labelled")
    evidence = fit_evidence(labelled)
    total = labelled.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    prior = ((total["good"] or 0.0) + 1) / (total["n"] + 2)

    sites = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = _shrunk(hosts.withColumn("prior", F.lit(prior)), "host_posterior")
    hosts = materialize(hosts.select("host", "host_posterior"), "hosts")
    paths = sites.join(hosts, "host").withColumnRenamed("host_posterior", "prior")
    paths = materialize(_shrunk(paths, "path_posterior").select("host", "path", "path_posterior"), "paths")
    return SiteModel(evidence, prior, hosts, paths)


def _shrunk(sites: DataFrame, name: str) -> DataFrame:
    strength = _strength(sites)
    return sites.withColumn(
        name, (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)
    )


def site_columns(host_col: str = "source", path_col: str = "lang") -> dict[str, Column]:
    """Host, and the path below it; a null counts as an empty name."""
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    return {"host": host, "path": F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit(""))}


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior,
    quality (probability of a good document) and kept.

    A null text counts as empty; its properties are 0. Repeated rows stay. The properties are
    measured once and written to the shared folder.
    """
    keep = {"doc_id": F.col(f"`{id_col}`"), **site_columns(host_col, path_col)}
    rows = materialize(measured(docs, text_col, **keep).select("keep.*", *PROPERTIES), "properties")
    found = fit(rows, labels).score(rows, threshold)
    return found.select(
        F.col("doc_id").alias(id_col), "host", "path", "evidence", "host_posterior", "path_posterior",
        "quality", "kept",
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """The documents that :func:`classify` keeps, with all their columns."""
    sites = site_columns(host_col, path_col)
    small = {"doc_id": F.col(f"`{id_col}`"), **sites}
    rows = materialize(measured(docs, text_col, **small).select("keep.*", *PROPERTIES), "properties")
    whole = {"row": F.struct(*(F.col(f"`{c}`") for c in docs.columns)), **sites}
    scored = fit(rows, labels).score(measured(docs, text_col, **whole).select("keep.*", *PROPERTIES), threshold)
    return scored.filter("kept").select("row.*")
