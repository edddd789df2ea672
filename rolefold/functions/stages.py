"""Application stages, job status and score bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# The six board stages, in board order.
STAGES = ["Ready to Apply", "Applied", "Reply Received", "Interview Scheduled", "Rejected", "Offer"]
# Where the advance action leads.
NEXT_STAGE = {
    "Ready to Apply": "Applied",
    "Applied": "Reply Received",
    "Reply Received": "Interview Scheduled",
    "Interview Scheduled": "Offer",
    "Rejected": "Ready to Apply",
    "Offer": "Offer",
}
READY = STAGES[0]


def canonical_stage(status: Column) -> Column:
    """Board stage of a stored status; legacy spellings are mapped, unknown ones count as ready."""
    return (
        F.when(F.lower(status) == "applied", F.lit("Applied"))
        .when(status.isin(STAGES), status)
        .otherwise(F.lit(READY))
    )


def job_status(stage: Column) -> Column:
    return F.when(stage.isin(READY, "ready"), F.lit("ready")).otherwise(F.lower(stage))


def next_stage(stage: Column) -> Column:
    step = F.create_map(*[F.lit(x) for pair in NEXT_STAGE.items() for x in pair])
    return F.coalesce(F.try_element_at(step, stage), stage)


def is_ready(status: Column) -> Column:
    return F.lower(status).isin("ready to apply", "ready")


def is_past_ready(status: Column) -> Column:
    """For a row that has an application: has it moved on? A missing status has."""
    return ~F.lower(strip(F.coalesce(status, F.lit("")))).isin("ready to apply", "ready")


def score_label(score: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Match: "), score.cast("string"), F.lit("%")), F.lit("Unevaluated"))


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("Unevaluated"))
        .when(score >= 80, F.lit("high"))
        .when(score >= 60, F.lit("mid"))
        .otherwise(F.lit("low"))
    )
