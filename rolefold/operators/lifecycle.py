"""Application lifecycle as an append-only event log.

Three kinds of events exist: ``created``, ``stage`` and ``notes``. Nothing is updated in place;
current state, history and audit trail are derived. Event order is (created_at, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stages import READY
from ..functions.text import blank_to_null
from ..functions.values import tolerant_timestamp
from ..schemas import EVENTS
from .ordering import GroupOrder

ORDER = ["created_at", "event_id"]
HISTORY_CHUNK = 1000


def _event(kind: str, **columns: Column) -> list[Column]:
    given = {"kind": F.lit(kind), **columns}
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS.fields]


def created_events(new_jobs: DataFrame, now: Column, stage: str = READY) -> DataFrame:
    """One event per row ``(event_id, application_id, job_id[, notes, resume_json, resume_html, platform_key])``."""
    optional = {c: F.col(c) for c in ("notes", "resume_json", "resume_html", "platform_key") if c in new_jobs.columns}
    return new_jobs.select(*_event(
        "created", event_id=F.col("event_id"), application_id=F.col("application_id"), job_id=F.col("job_id"),
        stage=F.lit(stage), note=optional.get("notes", F.lit(None)), created_at=now, **optional))


def without_application(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs that have no application yet, which makes creation idempotent."""
    return jobs.join(events.filter("kind = 'created'").select("job_id"), "job_id", "left_anti")


def _known(events: DataFrame) -> DataFrame:
    """(application_id, platform_key) of the applications that exist."""
    platform = F.col("platform_key") if "platform_key" in events.columns else F.lit(None).cast("string")
    return events.filter("kind = 'created'").select("application_id", platform.alias("platform_key"))


def stage_events(requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(event_id, application_id, stage, note, created_at)`` into events and unknown ids."""
    known = _known(events)
    accepted = requests.drop("platform_key").join(known, "application_id").select(*_event(
        "stage", platform_key=F.col("platform_key"), event_id=F.col("event_id"), application_id=F.col("application_id"), stage=F.col("stage"),
        note=F.col("note"), created_at=F.col("created_at")))
    return accepted, requests.join(known, "application_id", "left_anti")


def full_notes(notes: Column, recruiter: Column) -> Column:
    tag = F.concat(F.lit("[Recruiter: "), recruiter, F.lit("]"))
    return (
        F.when(F.coalesce(recruiter, F.lit("")) == "", notes)
        .when(F.coalesce(notes, F.lit("")) == "", tag)
        .otherwise(F.concat(notes, F.lit("\n"), tag)))


def audit_note(interview: Column, follow_up: Column) -> Column:
    """Raw date texts are kept, parseable or not."""
    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f" ({label}: "), value, F.lit(")"))).otherwise("")

    return F.concat(F.lit("Updated application notes"), part("Interview", interview), part("Follow-up", follow_up))


def notes_events(requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(event_id, application_id, notes, interview_date, follow_up_date, recruiter_info, created_at)``."""
    known = _known(events)
    accepted = requests.drop("platform_key").join(known, "application_id").select(*_event(
        "notes", platform_key=F.col("platform_key"), event_id=F.col("event_id"), application_id=F.col("application_id"),
        notes=full_notes(F.col("notes"), F.col("recruiter_info")),
        note=audit_note(F.col("interview_date"), F.col("follow_up_date")),
        interview_text=F.col("interview_date"), follow_up_text=F.col("follow_up_date"),
        created_at=F.col("created_at")))
    return accepted, requests.join(known, "application_id", "left_anti")


# Of each part of an application's state, the value is kept with the time and number of the event that set it; the greatest one counts.
PARTS = {
    "status": (("created", "stage"), "stage"), "notes": (("created", "notes"), "notes"),
    "resume_json": (("created",), "resume_json"), "resume_html": (("created",), "resume_html"),
}
DATES = {"interview_date": "interview_text", "follow_up_date": "follow_up_text"}


def partial_state(events: DataFrame) -> DataFrame:
    """One row per application of any part of the log, to be merged with others by ``merged_state``."""
    platform = F.max("platform_key") if "platform_key" in events.columns else F.lit(None).cast("string")
    dated = events.withColumns({f"__{part}": tolerant_timestamp(F.col(text)) for part, text in DATES.items()})

    def latest(value: Column, when: Column) -> Column:
        return F.max(F.when(when, F.struct(*ORDER, value.alias("value"))))

    created = F.col("kind") == "created"
    return dated.groupBy("application_id").agg(
        F.max("job_id").alias("job_id"),
        *[latest(F.col(value), F.col("kind").isin(*kinds)).alias(part) for part, (kinds, value) in PARTS.items()],
        *[latest(F.col(f"__{part}"), F.col(f"__{part}").isNotNull()).alias(part) for part in DATES],
        F.min(F.when(created, F.col("created_at"))).alias("created_at"),
        F.min(F.when(F.col("kind").isin("created", "stage") & (F.col("stage") == "Applied"), F.col("created_at"))).alias("first_applied_at"),
        F.max("created_at").alias("updated_at"),
        platform.alias("platform_key"))


def merged_state(parts: DataFrame) -> DataFrame:
    """One row per application from any number of partial states, in whatever order and however often they come."""
    return parts.groupBy("application_id").agg(
        *[F.max(c).alias(c) for c in ("job_id", *PARTS, *DATES)],
        F.min("created_at").alias("created_at"), F.min("first_applied_at").alias("first_applied_at"),
        F.max("updated_at").alias("updated_at"), F.max("platform_key").alias("platform_key"))


def state_values(merged: DataFrame) -> DataFrame:
    """A merged state without the events that its parts come from; columns as in ``current_state``."""
    return merged.select(
        "application_id", "job_id", *[F.col(f"{part}.value").alias(part) for part in ("status", "notes", *DATES, "resume_json", "resume_html")],
        "created_at", "first_applied_at", "updated_at", F.col("created_at").alias("applied_at"))


def current_state(events: DataFrame) -> DataFrame:
    """One row per application, by plain aggregates: partial results are combined before the
    shuffle, so an application with very many events costs no more than any other."""
    at = F.struct(*ORDER)
    moves = F.col("kind").isin("created", "stage")
    noted = F.col("kind").isin("created", "notes")

    def latest(value: str, when: Column) -> Column:
        return F.max_by(F.struct(F.col(value)), F.when(when, at))[value]

    dated = events.withColumns({
        "__interview": tolerant_timestamp(F.col("interview_text")),
        "__follow_up": tolerant_timestamp(F.col("follow_up_text")),
    })
    return dated.groupBy("application_id").agg(
        F.max("job_id").alias("job_id"),
        latest("stage", moves).alias("status"),
        latest("notes", noted).alias("notes"),
        latest("__interview", F.col("__interview").isNotNull()).alias("interview_date"),
        latest("__follow_up", F.col("__follow_up").isNotNull()).alias("follow_up_date"),
        latest("resume_json", F.col("kind") == "created").alias("resume_json"),
        latest("resume_html", F.col("kind") == "created").alias("resume_html"),
        F.min(F.when(F.col("kind") == "created", F.col("created_at"))).alias("created_at"),
        F.min(F.when(moves & (F.col("stage") == "Applied"), F.col("created_at"))).alias("first_applied_at"),
        F.max("created_at").alias("updated_at"),
    ).withColumn("applied_at", F.col("created_at"))


def latest_rows(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last row per key; the generic form of current state."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


def audit_trail(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``id, application_id, stage, note, created_at`` with default notes filled in."""
    keyed = events.select(
        "event_id", "application_id", "kind", "note", "created_at",
        F.when(F.col("kind").isin("created", "stage"), F.col("stage")).alias("moved_to"))
    traced = GroupOrder(keyed, ["application_id"], [F.col(c) for c in ORDER], block_rows).fill(
        {"moved_to": "stage"}).lag({"stage": "old_stage"}).result()
    default = F.when(F.col("kind") == "created", F.lit("Application initialized")).otherwise(
        F.concat(F.lit("Transitioned from "), F.col("old_stage"), F.lit(" to "), F.col("stage")))
    return traced.select(
        F.col("event_id").alias("id"), "application_id", "stage",
        F.coalesce(blank_to_null(F.col("note")), default).alias("note"), "created_at")


def history_entries(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Stage history, one row per entry: ``application_id, seq, stage, previous_stage, timestamp, note``."""
    moves = events.filter(F.col("kind").isin("created", "stage")).select(
        "event_id", "application_id", "kind", "stage", "note", "created_at")
    numbered = GroupOrder(moves, ["application_id"], [F.col(c) for c in ORDER], block_rows).lag(
        {"stage": "previous_stage"}).rank("seq").result()
    default = F.when(F.col("kind") == "created", F.lit("Application created")).otherwise(
        F.concat(F.lit("Stage transitioned to "), F.col("stage")))
    return numbered.select(
        "application_id", "seq", "stage", "previous_stage", F.col("created_at").alias("timestamp"),
        F.coalesce(blank_to_null(F.col("note")), default).alias("note"))


def history_json(entries: DataFrame, chunk: int = HISTORY_CHUNK) -> DataFrame:
    """History as JSON arrays of at most ``chunk`` entries: ``application_id, chunk, history``.

    An application with a usual history has the single chunk 0; a huge one is spread over many
    rows instead of being collected into one.
    """
    item = F.struct("seq", F.struct(
        "stage", "previous_stage", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "note"
    ).alias("entry"))
    part = F.floor((F.col("seq") - 1) / chunk).alias("chunk")
    return entries.groupBy("application_id", part).agg(F.sort_array(F.collect_list(item)).alias("items")).select(
        "application_id", "chunk", F.size("items").cast("bigint").alias("n_entries"),
        F.to_json(F.transform("items", lambda x: x["entry"])).alias("history"))


