"""Limits and thresholds, in one explicit object (nothing is read from the environment)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class IngestLimits:
    max_name_length: int = 255
    max_label_key_length: int = 100
    max_label_value_length: int = 500
    max_future_seconds: int = 300
    max_past_days: int = 365


@dataclass(frozen=True)
class CardinalityLimits:
    max_series_per_metric: int = 10_000
    max_labels_per_metric: int = 10
    max_label_value_length: int = 100
    warning_threshold: float = 0.8
    check_window_hours: int = 24
    # "unseen": a full metric still takes samples of series it already has.
    # "strict_all": a full metric takes nothing.
    # "quota": as "unseen", and a batch's new series are admitted in order of arrival until full.
    at_limit: str = "unseen"


@dataclass(frozen=True)
class QueryLimits:
    default_range_hours: int = 24
    max_range_days: int = 90
    max_export_days: int = 30
    max_limit: int = 10_000  # largest limit that a caller may ask for
    max_buckets: int | None = None  # newest buckets of an answer; None gives all
    instant_window_seconds: int = 60
    scan_rows: int = 1_000_000  # rows that opening one more rollup table must save; 0 opens any


@dataclass(frozen=True)
class SkewLimits:
    """Largest group a single task may hold; bigger groups are split (results stay exact)."""

    series_rows: int = 5_000_000
    percentile_rows: int = 2_000_000


@dataclass(frozen=True)
class Settings:
    ingest: IngestLimits = field(default_factory=IngestLimits)
    cardinality: CardinalityLimits = field(default_factory=CardinalityLimits)
    query: QueryLimits = field(default_factory=QueryLimits)
    skew: SkewLimits = field(default_factory=SkewLimits)
    default_retention_days: int = 30
    max_retention_days: int = 1825
    archive_after_days: int = 30
    hot_days: int = 10
    warm_days: int = 30
    # "strict": an unknown name is registered without labels, so labelled samples are rejected.
    # "adopt": it takes over the label keys of its first sample in the batch.
    auto_register_labels: str = "strict"
