"""The store: all tables below one root, and every job and query over them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.config import Settings
from seriesframe.functions.labels import from_key, literal_map
from seriesframe.functions.times import day_of, utc, utc_day
from seriesframe.operators import (
    aggregates, archive, cardinality, catalog, changes, counters, cover, lifecycle, postings,
    rollups, upsert,
)
from seriesframe.operators.filters import (
    check_range, default_range, filter_labels, filter_metric, filter_time,
)
from seriesframe.plans import request as queries
from seriesframe.plans.ingest import Ingested, batch_rows, validate_batch
from seriesframe.plans.request import Aggregation, QueryRequest
from seriesframe.schema import (
    INCOMING, LABELS_INDEX, MANIFEST, METRIC_LABELS, METRICS, POSTINGS, ROLLUP, RUNS, SAMPLES,
    SERIES_SEEN,
)
from seriesframe.session import configure, scratch
from seriesframe.sources import archive as archive_files
from seriesframe.sources import export as export_files
from seriesframe.sources import tables
from seriesframe.sources.samples import scan_samples


class SeriesStore:
    """Tables below ``root``, a folder all executors share.

    ``samples`` is kept by UTC day. Ingest batches land in ``incoming`` first, so no day is
    rewritten per batch; :meth:`merge_incoming` folds them into the days and scans lay them over
    the samples until then. Every table changes by one log entry (see ``sources.tables``), so a
    failed job leaves it as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.settings = settings
        self._rates: dict[str, dict[str, float]] = {}  # estimates by metric name; they only steer routing

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, schema) -> DataFrame:
        return tables.read_table(self.spark, self.path(table), schema)

    # Tables

    def metrics(self) -> DataFrame:
        return self._read("metrics", METRICS)

    def metric_labels(self) -> DataFrame:
        return self._read("metric_labels", METRIC_LABELS)

    def _scratch(self):
        return scratch(self.spark, self.path("_work"))

    def registry(self) -> DataFrame:
        return catalog.with_label_keys(self.metrics(), self.metric_labels())

    def incoming(self) -> DataFrame:
        """Batches that are not merged yet."""
        folders = [folder for _, _, folder in self._waiting()]
        return tables.read_folders(self.spark, self.path("incoming"), INCOMING, folders)

    def waiting_batches(self) -> int:
        return len({batch for batch, _, _ in self._waiting()})

    def _waiting(self) -> list[tuple[str, date, str]]:
        """(batch, day, folder) of what waits to be merged; one log entry is read, nothing is listed."""
        found = []
        for key, folders in tables.snapshot(self.spark, self.path("incoming")).items():
            day, batch = key.split("|", 1)
            found += ((batch, date.fromisoformat(day), folder) for folder in folders)
        return found

    def rollup(self, grain: str) -> DataFrame:
        return self._read(f"rollup_{grain}", ROLLUP)

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    def labels_index(self) -> DataFrame:
        return self._read("labels_index", LABELS_INDEX)

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def samples(
        self, metric_id: str | None = None, start=None, end=None,
        labels: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """Stored samples with waiting batches laid over them.

        The merge runs only on days that have waiting rows; other days are scanned as they are.
        """
        found = scan_samples(self.spark, self.path("samples"), metric_id, start, end, labels)
        days = sorted({day for _, day, _ in self._waiting()})
        if start is not None:
            days = [day for day in days if day_of(start) <= day <= day_of(end)]
        if not days:
            return found
        waiting = self.incoming()
        if metric_id is not None:
            waiting = filter_metric(waiting, metric_id)
        if start is not None:
            waiting = filter_time(waiting, start, end)
        if labels:
            waiting = filter_labels(
                waiting.withColumn("labels", from_key("labels_key")), labels
            ).drop("labels")
        touched = F.col("day").isin([F.lit(d) for d in days])
        merged = upsert.upsert(found.filter(touched), waiting)
        return found.filter(~touched).unionByName(merged)

    def points(
        self, metric_id: str, start, end, labels: Mapping[str, str] | None = None
    ) -> DataFrame:
        """Hot and archived samples of a metric; archived files are opened only for their days."""
        check_range(utc(start), utc(end), self.settings.query.max_range_days)
        hot = self.samples(metric_id, start, end, labels)
        first, last = day_of(start), day_of(end)
        cold_days = {d for d in tables.days_of(self.spark, self.path("manifest")) if first <= d <= last}
        if not cold_days:
            return hot
        cold = self.read_archive(metric_id, start, end, labels)
        return archive.unified_scan(hot, cold, cold_days & self._hot_days())

    def _hot_days(self) -> set[date]:
        return {*tables.days_of(self.spark, self.path("samples")), *(day for _, day, _ in self._waiting())}

    def _state_of_days(self) -> dict[str, list[str]]:
        """What a rollup of a day depends on: the folders of its samples, merged and waiting."""
        state = dict(tables.snapshot(self.spark, self.path("samples")))
        for batch, day, folder in self._waiting():
            state[day.isoformat()] = [*state.get(day.isoformat(), []), folder]
        return state

    def valid_days(self, grain: str, now: dict[str, list[str]] | None = None) -> list[date]:
        """Days whose rollups hold all their samples: nothing has changed since they were made.

        Archived days count as changed, since the archive may have been corrected.
        """
        made = tables.snapshot(self.spark, self.path(f"rollup_{grain}_state"))
        now = self._state_of_days() if now is None else now
        return [date.fromisoformat(day) for day, state in made.items() if now.get(day) == state]

    def series_seen(self) -> DataFrame:
        """One row per series and day, plus the rows waiting to be merged.

        The series limit is counted on this and not on the samples, so checking a batch reads
        as many rows as there are series, not as there are samples.
        """
        columns = SERIES_SEEN.names
        return self._read("series", SERIES_SEEN).unionByName(self.incoming().select(*columns))

    def _note_series(self, rows: DataFrame, days: list[date]) -> None:
        """Add the series of ``rows`` to those known on ``days``; no samples are read again."""
        known = tables.in_days(self._read("series", SERIES_SEEN), days)
        both = known.unionByName(rows.select(*SERIES_SEEN.names))
        seen = both.groupBy("metric_id", "labels_key", "day").agg(F.max("time").alias("time"))
        tables.overwrite_days(
            seen.select(*SERIES_SEEN.names), self.path("series"), tables.keyed("day")
        )

    def _drop_series(self, before: date) -> None:
        """Forget series of old days; the series limit looks back one check window only."""
        path = self.path("series")
        tables.drop_days(self.spark, path, [d for d in tables.days_of(self.spark, path) if d < before])

    def vacuum(self) -> None:
        """Delete the leftovers of failed jobs."""
        for table in ("metrics", "metric_labels", "samples", "incoming", "series", "manifest", "runs"):
            tables.vacuum(self.spark, self.path(table))

    # Catalogue

    def resolve(self, name: str):
        return catalog.resolve_metric(self.metrics(), name)

    def metric(self, metric_id: str):
        return catalog.metric_by_id(self.registry(), metric_id)

    def list_metrics(self, **options) -> DataFrame:
        return catalog.list_metrics(self.metrics(), self.metric_labels(), **options)

    def register(self, requests: DataFrame, as_of) -> DataFrame:
        """Validate and append registrations ``idx, name, type, ...``; returns them with reason."""
        kept_in = f"{self.path('_work')}/{uuid.uuid4().hex}"
        lazy = catalog.check_registrations(requests, self.metrics(), self.settings)
        lazy.write.parquet(kept_in)
        checked = self.spark.read.schema(lazy.schema).parquet(kept_in)
        self._append_metrics(checked.filter("reason IS NULL"), as_of)
        return checked

    def _append_metrics(self, accepted: DataFrame, as_of) -> None:
        tables.append_table(catalog.new_label_rows(accepted).select(*METRIC_LABELS.names), self.path("metric_labels"))
        made = catalog.new_metric_rows(accepted, as_of, self.settings)
        tables.append_table(made.select(*METRICS.names), self.path("metrics"))

    def update_metric(self, metric_id: str, as_of, **changes) -> None:
        catalog.metric_by_id(self.metrics(), metric_id)
        changed = catalog.update_metric(
            self.metrics(), metric_id, as_of, settings=self.settings, **changes
        )
        tables.replace_table(changed, self.path("metrics"))

    def deactivate_metric(self, metric_id: str, as_of) -> None:
        self.update_metric(metric_id, as_of, is_active=False)

    # Ingest

    def ingest(
        self, incoming: DataFrame, as_of, batch: str | None = None, order: list[str] | None = None
    ) -> Ingested:
        """Validate one batch and store what passes; the accepted rows are visible at once.

        A batch that is sent again while it waits replaces its earlier attempt, in that attempt's
        place; one that has been merged is only validated again. Between batches the one that was
        first seen last wins; within one, the last row by ``order``.
        """
        order = order or (["arrival"] if "arrival" in incoming.columns else ["idx"])
        batch = batch or uuid.uuid4().hex
        lazy = validate_batch(incoming, self.registry(), as_of, self.settings, self.series_seen())
        kept_in = f"{self.path('_work')}/{uuid.uuid4().hex}"
        lazy.validated.write.parquet(kept_in)
        stored = self.spark.read.schema(lazy.validated.schema).parquet(kept_in)
        done = replace(lazy, validated=stored, scratch=kept_in)
        with self._scratch() as keep:
            fresh = keep(done.registrations, "new-metrics")
            if not fresh.isEmpty():
                self._append_metrics(fresh, as_of)
        waiting = tables.snapshot(self.spark, self.path("incoming"))
        mine = [key for key in waiting if key.split("|", 1)[1].rsplit("#", 1)[0] == batch]
        if mine or not self._was_merged(batch):
            numbers = {key: int(key.rsplit("#", 1)[1]) for key in waiting}
            landed = min(numbers[k] for k in mine) if mine else max(numbers.values(), default=0) + 1
            rows = batch_rows(done.accepted, landed, order, batch).select(*INCOMING.names)
            made = tables.write_folder(rows, self.path("incoming"))
            changes = {key: [] for key in mine}
            changes |= {f"{day}|{batch}#{landed}": folders for day, folders in made.items()}
            tables.commit(self.spark, self.path("incoming"), changes)
        done.rejected.write.mode("overwrite").parquet(self.path(f"rejects/batch={batch}"))
        passed = F.col("reason").isNull()
        accepted, rejected = done.validated.agg(F.count_if(passed), F.count_if(~passed)).first()
        self._log([
            self._run("ingest", "COMPLETED", as_of, as_of, 0, accepted, run_id=f"{batch}/accepted"),
            self._run("reject", "COMPLETED", as_of, as_of, 0, rejected, run_id=f"{batch}/rejected"),
        ])
        return done

    def _was_merged(self, batch: str) -> bool:
        return not self.runs().filter(F.col("id") == f"{batch}/merged").isEmpty()

    def ingest_totals(self) -> DataFrame:
        """Accepted and rejected samples over all batches; a repeated batch counts once."""
        runs = self.runs().filter(F.col("job_type").isin("ingest", "reject"))
        once = runs.groupBy("id", "job_type").agg(F.max("rows_migrated").alias("rows"))
        return once.agg(
            F.sum(F.when(F.col("job_type") == "ingest", F.col("rows"))).alias("total_accepted"),
            F.sum(F.when(F.col("job_type") == "reject", F.col("rows"))).alias("total_rejected"),
        )

    def merge_incoming(self) -> None:
        """Fold waiting batches into the day partitions. Repeating it changes nothing."""
        waiting = self._waiting()
        days = sorted({day for _, day, _ in waiting})
        if not days:
            return
        rows = self.incoming()
        stored = tables.in_days(scan_samples(self.spark, self.path("samples")), days)
        self._note_series(rows, days)
        tables.overwrite_days(upsert.upsert(stored, rows), self.path("samples"))
        # A name that is sent again from here on is known to be merged.
        now = datetime.now(timezone.utc)
        names = sorted({batch.rsplit("#", 1)[0] for batch, _, _ in waiting})
        self._log([self._run("merge", "COMPLETED", now, now, run_id=f"{n}/merged") for n in names])
        merged = tables.snapshot(self.spark, self.path("incoming"))
        tables.commit(self.spark, self.path("incoming"), {key: [] for key in merged})

    def upsert_samples(self, rows: DataFrame, order: list[str]) -> None:
        """Merge ``time, metric_id, value, labels_key`` rows straight into their days.

        Of several rows with one key the last by ``order`` wins, and it wins over stored ones.
        """
        kept = upsert.last_wins(rows, order).withColumn("day", utc_day("time"))
        with self._scratch() as keep:
            fresh = keep(kept.withColumn("landed", F.lit(0).cast("long")), "upsert")
            days = [row["day"] for row in fresh.select("day").distinct().collect()]
            stored = tables.in_days(scan_samples(self.spark, self.path("samples")), days)
            self._note_series(fresh, days)
            tables.overwrite_days(upsert.upsert(stored, fresh), self.path("samples"))

    def upsert_and_refresh(self, rows: DataFrame, order: list[str]) -> None:
        """:meth:`upsert_samples`, and the rollups brought up to date by what it changed.

        Days whose rollups were complete before take the changes cell by cell; samples are read
        again only where an extreme was taken back. Other touched days are rolled up from samples.
        """
        self._rates.clear()
        kept = upsert.last_wins(rows, order).withColumn("day", utc_day("time"))
        with self._scratch() as keep:
            fresh = keep(kept.withColumn("landed", F.lit(0).cast("long")), "upsert")
            days = [row["day"] for row in fresh.select("day").distinct().collect()]
            stored = tables.in_days(scan_samples(self.spark, self.path("samples")), days)
            changed = keep(changes.sample_changes(stored, fresh), "changes")
            complete = {grain: set(self.valid_days(grain)) for grain in rollups.GRAINS}
            self._note_series(fresh, days)
            tables.overwrite_days(upsert.upsert(stored, fresh), self.path("samples"))
            state = self._state_of_days()
            after = tables.in_days(scan_samples(self.spark, self.path("samples")), days)
            for grain in rollups.GRAINS:
                whole = [day for day in days if day in complete[grain]]
                others = [day for day in days if day not in complete[grain]]
                deltas = keep(
                    changes.bucket_deltas(changed.filter(utc_day("time").isin(whole)), grain), f"deltas-{grain}"
                )
                made = changes.refresh(tables.in_days(self.rollup(grain), whole), deltas, after, grain)
                if others:
                    made = made.unionByName(rollups.rollup(tables.in_days(after, others), grain).select(*made.columns))
                tables.replace_days(made.withColumn("day", utc_day("bucket")), self.path(f"rollup_{grain}"), days)
                tables.commit(
                    self.spark, self.path(f"rollup_{grain}_state"),
                    {day.isoformat(): state.get(day.isoformat(), []) for day in days},
                )

    # Queries

    def query(self, request: QueryRequest, as_of) -> DataFrame:
        """``timestamp, value, labels``; lazy."""
        start, end, _ = queries.check_request(request, self.settings, as_of)
        metric = self.resolve(request.metric)
        found = self.points(metric["id"], start, end)
        return queries.plan(request, found, metric["type"], as_of, self.settings)

    def _rows_per_day(self, name: str) -> dict[str, float]:
        """Estimated rows a day of a metric, from its daily rollup; empty without one."""
        if not self._rates.get(name):
            daily = filter_metric(self.rollup("1d"), self.resolve(name)["id"])
            self._rates[name] = cover.finer_rows(cover.estimate_rows({"1d": daily}))
        return self._rates[name]

    def routed_query(
        self, request: QueryRequest, as_of, fresh_until=None, scan_rows: int | None = None
    ) -> DataFrame:
        """Like :meth:`query`, answering plain bucket aggregates from the rollups.

        Days come from daily rollups where the answer allows it, the rest of the range from hourly
        and 5-minute ones, and its edges from samples; only days whose rollups are known to be
        complete come from them. Without an interval the whole range is one answer. A rollup that
        saves fewer than ``scan_rows`` rows, by estimate, is not opened (None: as in the settings).
        """
        start, end, width = queries.check_request(request, self.settings, as_of)
        plain = request.aggregation and request.aggregation.value in aggregates.PLAIN_AGGREGATES
        grains = cover.fitting_grains(width)
        first, last = day_of(start), day_of(end)
        if not (plain and grains):
            return self.query(request, as_of)
        least = self.settings.query.scan_rows if scan_rows is None else scan_rows
        rates = self._rows_per_day(request.metric) if least else {}
        if rates and rates[cover.RAW] * ((utc(end) - utc(start)) / timedelta(days=1)) < least:
            return self.query(request, as_of)
        state = self._state_of_days()
        valid = {grain: [day for day in self.valid_days(grain, state) if first <= day <= last] for grain in grains}
        if not any(valid.values()):
            return self.query(request, as_of)
        metric_id = self.resolve(request.metric)["id"]
        pieces = cover.range_cover(start, end, grains, valid, fresh_until, rates, least)
        rows = {}
        for grain in {piece.grain for piece in pieces} - {cover.RAW}:
            mine = [piece for piece in pieces if piece.grain == grain]
            table = filter_metric(
                tables.read_table(
                    self.spark, self.path(f"rollup_{grain}"), ROLLUP, mine[0].begin.date(), mine[-1].end.date()
                ), metric_id,
            )
            if request.labels:
                table = filter_labels(table.withColumn("labels", from_key("labels_key")), request.labels)
            rows[grain] = table
        raw = [piece for piece in pieces if piece.grain == cover.RAW]
        points = None
        if raw:
            points = self.points(metric_id, raw[0].begin, raw[-1].end - timedelta(microseconds=1), request.labels)
        if width:
            made = cover.covered_buckets(points, rows, pieces, width)
        else:
            made = cover.covered_total(points, rows, pieces, start)
        made = rollups.routed_agg(made, request.aggregation.value, self.settings.query.max_buckets)
        return made.select(
            F.col("bucket").alias("timestamp"), "value", literal_map(request.labels).alias("labels")
        )

    def instant(self, name: str, at, labels: Mapping[str, str] | None = None) -> DataFrame:
        seconds = self.settings.query.instant_window_seconds
        request = QueryRequest(
            name, utc(at) - timedelta(seconds=seconds), utc(at), labels or {}, limit=1
        )
        return self.query(request, at)

    def range_query(self, name: str, start, end, step: str, labels=None) -> DataFrame:
        request = QueryRequest(
            name, start, end, labels or {}, Aggregation.AVG, step
        )
        return self.query(request, end)

    def statistics(self, name: str, as_of, start=None, end=None) -> DataFrame:
        first, last = default_range(start, end, as_of, self.settings.query.default_range_hours)
        found = self.points(self.resolve(name)["id"], first, last)
        return aggregates.statistics(found, self.settings.skew.percentile_rows)

    def counter_rate(self, name: str, start, end, labels=None, include_first: bool = False) -> DataFrame:
        found = self.points(self.resolve(name)["id"], start, end, labels)
        return counters.rate(found, self.settings.skew.series_rows, include_first)

    def counter_increase(self, name: str, start, end, labels=None) -> DataFrame:
        return counters.counter_increase(self.points(self.resolve(name)["id"], start, end, labels))

    def rate_from_rollup(self, name: str, grain: str, start, end, labels=None) -> DataFrame:
        rows = rollups.rollup_rows(self.rollup(grain), self.resolve(name)["id"], start, end, labels)
        return counters.rate_from_rollup(rows)

    def cardinality_stats(self, as_of) -> DataFrame:
        return cardinality.cardinality_stats(self.series_seen(), as_of, self.settings.cardinality)

    def export(self, name: str, start, end, file_format: str, path: str, labels=None) -> None:
        """All points of at most 30 days, in the given format."""
        check_range(utc(start), utc(end), self.settings.query.max_export_days)
        request = QueryRequest(name, start, end, labels or {})
        export_files.export(self.query(request, end), name, file_format, path)

    # Rollups

    def refresh_rollups(self) -> None:
        """Rebuild the rollups of all hot days; hours come from 5-minute rows and days from hours.

        Rollups of days that are archived stay.
        """
        self._rates.clear()
        state = self._state_of_days()
        finer = None
        for grain in ("5m", "1h", "1d"):
            made = (
                rollups.rollup(self.samples(), grain) if finer is None
                else rollups.coarsen(finer, grain)
            )
            tables.overwrite_days(
                made.withColumn("day", utc_day("bucket")), self.path(f"rollup_{grain}")
            )
            finer = tables.in_days(self.rollup(grain), [date.fromisoformat(day) for day in state])
            tables.commit(self.spark, self.path(f"rollup_{grain}_state"), state)

    def refresh_band(self, grain: str, as_of) -> None:
        """Recompute only the buckets inside the refresh band of ``as_of``, from samples."""
        begin, until = rollups.refresh_band(grain, as_of)
        if begin >= until:
            return
        last = until - timedelta(microseconds=1)
        days = [
            day_of(begin) + timedelta(days=n) for n in range((day_of(last) - day_of(begin)).days + 1)
        ]
        state = self._state_of_days()
        table = tables.in_days(self.rollup(grain), days)
        outside = table.filter((F.col("bucket") < F.lit(begin)) | (F.col("bucket") >= F.lit(until)))
        made = rollups.rollup(self.samples(start=begin, end=last), grain)
        band = made.withColumn("day", utc_day("bucket"))
        tables.replace_days(
            outside.unionByName(band.select(*outside.columns)), self.path(f"rollup_{grain}"), days
        )
        whole = [
            d.isoformat() for d in days
            if begin <= utc(d.isoformat()) and utc((d + timedelta(days=1)).isoformat()) <= until
        ]
        if whole:
            tables.commit(
                self.spark, self.path(f"rollup_{grain}_state"), {day: state.get(day, []) for day in whole}
            )

    # Lifecycle

    def archive(self, as_of, file_format: str = "parquet") -> None:
        """Move complete old days to the archive: files, label index, manifest, then out of hot.

        Rows that have come late for an archived day are merged with what it holds and written to
        a new folder, which its manifest row then names. Safe to repeat after a crash at any point:
        files that the manifest names never change, and days leave the hot table last.
        """
        self.merge_incoming()
        before = archive.cutoff_day(as_of, self.settings.archive_after_days)
        days = [d for d in tables.days_of(self.spark, self.path("samples")) if d < before]
        if not days:
            return
        hot = tables.in_days(scan_samples(self.spark, self.path("samples")), days)
        known = tables.in_days(self.manifest(), days)
        with self._scratch() as keep:
            new = keep(archive.archive_candidates(hot, known, before), "candidates")
            if not new.isEmpty():
                moving = hot.join(new, archive.METRIC_DAY, "left_semi")
                self._archive_rows(moving, new, as_of, file_format, file_format, days)
            if not known.isEmpty():
                late = hot.select(*archive.METRIC_DAY).join(known, archive.METRIC_DAY, "left_semi").distinct()
                late = keep(late, "late")
                if not late.isEmpty():
                    rows = hot.join(late, archive.METRIC_DAY, "left_semi")
                    cold = archive_files.read_archive_days(self.spark, self.path("archive"), known, days)
                    cold = cold.join(late, archive.METRIC_DAY, "left_semi")
                    base = f"{file_format}.{uuid.uuid4().hex[:12]}"
                    self._archive_rows(archive.unified_scan(rows, cold), late, as_of, file_format, base, days)
        moved = hot.agg(F.countDistinct("metric_id"), F.count(F.lit(1))).first()
        tables.drop_days(self.spark, self.path("samples"), days)
        self._drop_series(before)
        self.log_run("archive", "COMPLETED", as_of, as_of, moved[0], moved[1])

    def _archive_rows(
        self, moving: DataFrame, pairs: DataFrame, as_of, file_format: str, base: str, days: list[date]
    ) -> None:
        """Files, then their label index, then the manifest, for the (metric, day) in ``pairs``."""
        key = archive.METRIC_DAY
        archive_files.write_archive(moving, self.path("archive"), file_format, base)
        index = archive.labels_index(moving).select(*LABELS_INDEX.names)
        other = tables.in_days(self.labels_index(), days).join(pairs, key, "left_anti")
        tables.overwrite_days(
            other.select(*LABELS_INDEX.names).unionByName(index), self.path("labels_index"),
            tables.keyed("day", "metric_id"),
        )
        tables.replace_table(
            postings.merge_postings(self.postings(), postings.label_postings(index)), self.path("postings")
        )
        # The manifest follows from the index, which has a row per series and not per sample.
        index = tables.in_days(self.labels_index(), days).join(pairs, key, "left_semi")
        sizes = archive_files.folder_sizes(self.spark, self.path("archive"), base, days)
        rows = archive.manifest_rows(index, as_of, file_format, base).join(sizes, key, "left")
        other = tables.in_days(self.manifest(), days).join(pairs, key, "left_anti")
        tables.overwrite_days(
            other.select(*MANIFEST.names).unionByName(rows.select(*MANIFEST.names)),
            self.path("manifest"), tables.keyed("day"),
        )

    def read_archive(self, metric_id: str, start, end, labels: Mapping[str, str] | None = None) -> DataFrame:
        return archive_files.read_archive(
            self.spark, self.path("archive"), self.manifest(), metric_id, start, end, labels, self.postings()
        )

    def unified_samples(self, name: str, start, end, labels=None) -> DataFrame:
        """Hot and archived samples of a metric in one frame."""
        return self.points(self.resolve(name)["id"], start, end, labels)

    def apply_retention(self, as_of) -> None:
        """Delete samples older than the retention of their metric.

        Days beyond the longest retention are dropped as folders, unread. Of the younger days
        only those that hold expired rows are rewritten.
        """
        self.merge_incoming()
        default = self.settings.default_retention_days
        limits = self.metrics().agg(F.min("retention_days"), F.max("retention_days")).first()
        shortest, longest = min(limits[0] or default, default), max(limits[1] or default, default)
        dead = day_of(utc(as_of) - timedelta(days=longest))
        path = self.path("samples")
        tables.drop_days(self.spark, path, [d for d in tables.days_of(self.spark, path) if d < dead])
        # No younger day can hold an expired row, so it is not scanned.
        youngest = day_of(utc(as_of) - timedelta(days=shortest))
        hot = tables.read_table(self.spark, path, SAMPLES, last=youngest)
        stale = lifecycle.expired(hot, self.metrics(), as_of, default)
        days = [row["day"] for row in stale.select("day").distinct().collect()]
        if days:
            kept = lifecycle.retained(tables.in_days(hot, days), self.metrics(), as_of, default)
            tables.replace_days(kept, path, days)

    def purge_manifest(self, cutoff) -> None:
        """Drop manifest rows created before the cutoff."""
        manifest = self.manifest()
        old = manifest.filter(F.col("created_at") < F.lit(utc(cutoff)))
        days = [row["day"] for row in old.select("day").distinct().collect()]
        if days:
            kept = archive.purge_manifest(tables.in_days(manifest, days), cutoff)
            tables.replace_days(kept, self.path("manifest"), days, tables.keyed("day"))

    def log_run(self, job_type: str, status: str, start_time, end_time, *counts) -> None:
        """Append one row to the run log: metrics processed, rows migrated, error message."""
        self._log([self._run(job_type, status, start_time, end_time, *counts)])

    @staticmethod
    def _run(
        job_type: str, status: str, start_time, end_time, metrics_processed: int = 0,
        rows_migrated: int = 0, error_message: str | None = None, run_id: str | None = None,
    ) -> tuple:
        return (
            run_id or uuid.uuid4().hex, job_type, status, utc(start_time), utc(end_time),
            metrics_processed, rows_migrated, error_message, utc(end_time), utc(end_time),
        )

    def _log(self, rows: list[tuple]) -> None:
        made = self.spark.createDataFrame(rows, RUNS).coalesce(1)
        tables.append_table(made, self.path("runs"))
