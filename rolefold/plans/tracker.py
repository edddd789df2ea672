"""Applications on top of a store: creating, moving, annotating and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stages import READY
from ..operators.dedup import top_n
from ..operators.lifecycle import (
    audit_trail, created_events, history_entries, notes_events, stage_events, without_application,
)
from ..operators.ordering import with_position
from ..session import materialise
from . import board, queues
from .store import ListingStore, single_requests


class Tracker:
    """Every change takes a table of requests and appends to the log; every read is derived from it.

    Changes return the requests they refused, those for applications that do not exist.
    """

    def __init__(self, store: ListingStore):
        self.store, self.spark = store, store.spark

    def _in_order(self, requests: DataFrame, columns: list[str], now: Column) -> DataFrame:
        """Requests numbered in the order of ``created_at`` and ``ordinal``, as far as given, then of their applications."""
        order = [c for c in ("created_at", "ordinal") if c in requests.columns]
        if not order:
            single_requests(requests, ["application_id"], "ordinal")
        shaped = requests.select("application_id", *order, *[
            (F.col(c) if c in requests.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        at = F.coalesce(F.col("created_at").cast("timestamp"), now) if "created_at" in order else now
        shaped = shaped.withColumn("created_at", at)
        return self._numbered(shaped, ["created_at", *[c for c in order if c == "ordinal"], "application_id"]).drop("ordinal")

    def _numbered(self, requests: DataFrame, order: list) -> DataFrame:
        return with_position(requests, order).withColumn("event_id", F.col("pos") + self.store.next_event_id()).drop("pos")

    # -- changes ---------------------------------------------------------------------------

    def create(self, jobs: DataFrame, now: Column, stage: str = READY) -> DataFrame:
        """Applications for ``job_id[, notes, resume_json, resume_html]``; a job that has one keeps it.

        Returns ``job_id, application_id, is_new``.
        """
        events = self.store.read("events")
        kept = events.filter("kind = 'created'").select("job_id", "application_id").join(
            jobs.select("job_id").distinct(), "job_id", "left_semi")
        unique = top_n(jobs, ["job_id"], sorted(jobs.columns), 1)
        fresh = self._numbered(self.store.platforms_of(without_application(unique, events)), [F.col("job_id")])
        fresh = fresh.withColumn("application_id", F.col("event_id"))
        known = kept.withColumn("is_new", F.lit(False))
        made = fresh.select("job_id", "application_id", F.lit(True).alias("is_new"))
        # Written before the log grows, or the new ones would show up as known.
        result = materialise(known.unionByName(made), "created")
        self.store.append_events(created_events(fresh, now, stage))
        return result

    def move(self, requests: DataFrame, now: Column) -> DataFrame:
        """``application_id, stage[, note][, created_at][, ordinal]``; any stage name is accepted.

        Requests for one application follow each other by ``created_at``, then ``ordinal``; one of them must be given where there are several.
        """
        numbered = self._in_order(requests, ["stage", "note"], now)
        accepted, refused = stage_events(numbered, self.store.read("events"))
        self.store.append_events(accepted)
        return refused.select("application_id")

    def mark_applied(self, application_ids: DataFrame, now: Column) -> DataFrame:
        return self.move(application_ids.select("application_id", F.lit("Applied").alias("stage")), now)

    def annotate(self, requests: DataFrame, now: Column) -> DataFrame:
        """``application_id, notes[, interview_date, follow_up_date, recruiter_info][, created_at][, ordinal]``, fields by name; order as in ``move``."""
        numbered = self._in_order(requests, ["notes", "interview_date", "follow_up_date", "recruiter_info"], now)
        accepted, refused = notes_events(numbered, self.store.read("events"))
        self.store.append_events(accepted)
        return refused.select("application_id")

    # -- reads -----------------------------------------------------------------------------

    def applications(self) -> DataFrame:
        return self.store.applications()

    def table(self) -> DataFrame:
        return board.applications_table(self.applications(), self.store.listings())

    def board(self) -> DataFrame:
        return board.board(self.applications(), self.store.listings())

    def stage_counts(self) -> DataFrame:
        return board.stage_counts(self.spark, self.applications())

    def ready(self) -> DataFrame:
        return board.ready_list(self.applications(), self.store.listings())

    def pending(self, limit: int | None = None) -> DataFrame:
        return queues.pending_queue(self.store.listings(), self.applications(), limit)

    def candidates(self, min_score: int = 70, limit: int | None = None) -> DataFrame:
        return queues.candidate_queue(self.store.listings(), self.applications(), min_score, limit)

    def listings(self, newest_first: bool = True) -> DataFrame:
        return queues.all_listings(self.store.listings(), newest_first)

    def applied_flags(self) -> DataFrame:
        return board.applied_flags(self.store.listings(), self.applications())

    def timeline(self, application_id: int | None = None) -> DataFrame:
        """Audit trail in time order, of one application or of all."""
        events = self.store.read("events")
        if application_id is not None:
            events = events.filter(F.col("application_id") == application_id)
        return audit_trail(events).orderBy("created_at", "id")

    def history(self) -> DataFrame:
        return history_entries(self.store.read("events"))
