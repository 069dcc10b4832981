"""Label sets: canonical key, containment, high-cardinality test, text forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# A label key holding one of these words is likely to have many values.
HIGH_CARDINALITY_WORDS = [
    "id", "uuid", "guid", "session", "request", "transaction", "user", "customer", "account",
    "email", "username", "ip", "address", "timestamp", "datetime", "random", "nonce", "token",
]


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def or_empty(labels: Column | str) -> Column:
    return F.coalesce(_col(labels), F.create_map().cast("map<string,string>"))


def distinct_labels(labels: Column | str) -> Column:
    """The label map with one value per key: of a key that JSON text repeats, the last one."""
    keys, values = F.map_keys(_col(labels)), F.map_values(_col(labels))

    def last(key: Column) -> Column:
        return F.get(values, F.size(keys) - F.array_position(F.reverse(keys), key).cast("int"))

    single = F.array_distinct(keys)
    repaired = F.map_from_arrays(single, F.transform(single, last))
    return F.when(F.size(keys) > F.size(single), repaired).otherwise(_col(labels))


def canonical_key(labels: Column | str) -> Column:
    """Text that is equal exactly when two label sets are equal, whatever their key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(or_empty(labels)))))


def from_key(labels_key: Column | str) -> Column:
    """The label map of a canonical key; blank text is the empty set."""
    text = F.coalesce(F.nullif(F.trim(_col(labels_key)), F.lit("")), F.lit("{}"))
    return F.from_json(text, "map<string,string>")


def contains(labels: Column | str, wanted: Mapping[str, str] | None) -> Column:
    """True where every wanted pair is present; a missing key gives NULL, so the row drops."""
    condition = F.lit(True)
    for key, value in sorted((wanted or {}).items()):
        condition = condition & (_col(labels)[key] == F.lit(value))
    return condition


def literal_map(labels: Mapping[str, str] | None) -> Column:
    pairs = [F.lit(part) for pair in sorted((labels or {}).items()) for part in pair]
    return F.create_map(*pairs).cast("map<string,string>")


def is_high_cardinality(key: Column | str) -> Column:
    return F.lower(_col(key)).rlike("|".join(HIGH_CARDINALITY_WORDS))


def high_cardinality_keys(labels: Column | str) -> Column:
    return F.filter(F.map_keys(or_empty(labels)), is_high_cardinality)


def prometheus_labels(labels: Column | str) -> Column:
    """``{k="v",...}`` with the escapes of the text format; empty text without labels."""

    def pair(entry: Column) -> Column:
        value = F.replace(entry["value"], F.lit("\\"), F.lit("\\\\"))
        value = F.replace(value, F.lit('"'), F.lit('\\"'))
        value = F.replace(value, F.lit("\n"), F.lit("\\n"))
        return F.concat(entry["key"], F.lit('="'), value, F.lit('"'))

    entries = F.array_sort(F.map_entries(or_empty(labels)))
    text = F.array_join(F.transform(entries, pair), ",")
    return F.when(F.size(entries) > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(F.lit(""))
