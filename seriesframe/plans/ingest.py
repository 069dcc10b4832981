"""From incoming samples to accepted and rejected rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.config import Settings
from seriesframe.functions.times import utc_day
from seriesframe.operators import cardinality, catalog, validation
from seriesframe.operators.upsert import last_wins
from seriesframe.sources.files import delete


@dataclass
class Ingested:
    """Outcome of one batch; all frames are views of the validated rows."""

    validated: DataFrame
    registry: DataFrame
    adopt: bool = False
    scratch: str | None = None

    def release(self) -> None:
        """Delete the written validated rows once the outcome has been looked at."""
        if self.scratch is not None:
            delete(self.validated.sparkSession, self.scratch)

    @property
    def registrations(self) -> DataFrame:
        """Unknown names to register: those of rows that pass the sample rules."""
        return catalog.auto_registrations(
            self.validated.filter("sample_ok"), self.registry, self.adopt
        )

    @property
    def accepted(self) -> DataFrame:
        return self.validated.filter("reason IS NULL")

    @property
    def rejected(self) -> DataFrame:
        return self.validated.filter("reason IS NOT NULL").select("idx", "name", "reason")

    @property
    def summary(self) -> DataFrame:
        return validation.split_summary(self.validated)


def validate_batch(
    incoming: DataFrame,
    registry: DataFrame,
    as_of,
    settings: Settings = Settings(),
    stored: DataFrame | None = None,
) -> Ingested:
    """Apply every ingest rule in order.

    ``registry`` is the metric dimension with ``label_keys``; ``stored`` the samples that the
    series limit is counted on. Rows passing the sample rules register unknown names, also
    when a label rule rejects the row afterwards.
    """
    adopt = settings.auto_register_labels == "adopt"
    rows = validation.normalize(incoming, as_of)
    problem = F.col("problem") if "problem" in incoming.columns else F.lit(None).cast("string")
    rows = rows.withColumn(
        "reason", F.coalesce(problem, validation.sample_problem(as_of, settings))
    )
    rows = rows.withColumn("sample_ok", F.col("reason").isNull())
    known = registry.select("name", "id", "label_keys")
    if adopt:
        registrations = catalog.auto_registrations(rows.filter("sample_ok"), registry, adopt)
        known = known.unionByName(registrations.select(
            "name", catalog.metric_uuid("name").alias("id"), F.col("labels").alias("label_keys")
        ))
    rows = (
        validation.attach_registry(rows, known)
        .withColumn("metric_id", F.coalesce("metric_id", catalog.metric_uuid("name")))
        .withColumn("label_keys", F.coalesce("label_keys", F.array().cast("array<string>")))
    )
    if stored is None:
        full, series = None, None
    else:
        eligible = F.coalesce(
            "reason", validation.schema_problem(settings), validation.cardinality_problem(settings)
        ).isNull()
        rows = cardinality.mark_series_limit(
            rows, stored, as_of, settings.cardinality,
            order="arrival" if "arrival" in incoming.columns else "idx", eligible=eligible,
        )
        full, series = F.col("over_limit"), F.col("series")
    rows = rows.withColumn("reason", F.coalesce(
        "reason",
        validation.schema_problem(settings),
        validation.cardinality_problem(settings, full),
    )).withColumn("warnings", validation.cardinality_warnings(settings, series))
    return Ingested(rows, registry, adopt)


def batch_rows(accepted: DataFrame, landed: int, order: list[str], batch: str) -> DataFrame:
    """Accepted rows as they wait for merging: one per key, the last arrival of the batch."""
    kept = last_wins(accepted.withColumnRenamed("timestamp", "time"), order)
    return kept.select(
        "time", "metric_id", "value", "labels_key", F.lit(landed).cast("long").alias("landed"),
        F.lit(batch).alias("batch"), utc_day("time").alias("day"),
    )
