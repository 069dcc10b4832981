"""URL allow and block lists: a trie over reversed host labels, then path segments."""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow

ALLOW, BLOCK = "allow", "block"
MAX_TRIE_BYTES = 200_000_000


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


class _Node:
    __slots__ = ("below", "paths", "ends")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.paths: _Node | None = None  # on host nodes: the root of the path trie
        self.ends: list[tuple[str, tuple]] = []  # on path nodes: (start of the next segment, rule)


class UrlTrie:
    """Longest fitting rule of a (host, path).

    The rule with the longest ``host + path`` wins; of equally long ones that with the longer
    host; of rules that name the same place the blocking one.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            if rule.verdict not in (ALLOW, BLOCK):
                raise ValueError(f"unknown verdict {rule.verdict!r}")
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            *whole, rest = rule.path.split("/")
            node = node.paths
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            rank = (len(rule.name), len(rule.host), rule.verdict == BLOCK)
            node.ends.append((rest, (rank, rule.name, rule.verdict)))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) or None; an empty host fits no rule."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.get(label)
            if node is None:
                break
            place = node.paths
            for segment in segments:
                if place is None:
                    break
                for rest, found in place.ends:
                    if segment.startswith(rest) and (best is None or found > best):
                        best = found
                place = place.below.get(segment)
        return best[1:] if best else None


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, else empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end, else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url",
    otherwise: str = ALLOW,
) -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits) and verdict.

    A null url and one without ``://`` have an empty host and path, fit no rule and get
    ``otherwise``. Repeated rows stay. The trie is broadcast; a rule list whose trie is larger than
    ``MAX_TRIE_BYTES`` is refused, none of it is left out.
    """
    trie = UrlTrie(rules)
    if len(pickle.dumps(trie)) > MAX_TRIE_BYTES:
        raise ValueError("the rule list is too large to broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(trie)
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(
        F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path")
    )

    def judge(batches):
        find = shared.value.find
        for batch in batches:
            found = [
                find(host, path) or (None, otherwise)
                for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    kind = parts.schema["id"].dataType.simpleString()
    judged = map_arrow(
        parts, judge, f"id {kind}, host string, path string, rule string, verdict string"
    )
    return judged.withColumnRenamed("id", id_col)
