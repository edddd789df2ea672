"""Read models over applications and their listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stages import READY, STAGES, canonical_stage, is_past_ready, is_ready, score_band, score_label
from ..functions.text import blank_to_null, html_escape
from ..operators.ordering import with_position
from ..functions.values import NOT_SPECIFIED

APPLICATION_COLUMNS = [
    "applied_at", "interview_date", "follow_up_date", "notes", "resume_json", "resume_html",
]
LISTING_COLUMNS = [
    "platform", "job_id_on_platform", "title", "company", "location", "url", "salary", "salary_range",
    "remote_level", "skills", "skills_required", "match_score", "match_reasoning", "evaluation_details",
    "date_posted",
]


def applications_with_listings(applications: DataFrame, listings: DataFrame) -> DataFrame:
    """Inner join on the listing; only the columns present on either side are carried."""
    left = applications.select(
        F.col("id").alias("app_id"), "job_id", F.col("status").alias("app_status"),
        *[c for c in APPLICATION_COLUMNS if c in applications.columns],
        F.col("created_at").alias("app_created_at"), F.col("updated_at").alias("app_updated_at"))
    right = listings.select(
        F.col("id").alias("job_id"), *[c for c in LISTING_COLUMNS if c in listings.columns],
        *([F.col("status").alias("job_status")] if "status" in listings.columns else []))
    return left.join(right, "job_id")


def _recent():
    return F.coalesce("app_updated_at", "app_created_at")


def applications_table(applications: DataFrame, listings: DataFrame) -> DataFrame:
    """All applications, stages as stored, newest first."""
    return applications_with_listings(applications, listings).drop("job_status").orderBy(
        _recent().desc_nulls_last(), F.col("app_id").desc())


def ready_list(applications: DataFrame, listings: DataFrame) -> DataFrame:
    """Applications still to be sent, best score first; ties by recency, then id."""
    ready = applications.filter(is_ready(F.col("status")))
    return applications_with_listings(ready, listings).orderBy(
        F.col("match_score").desc_nulls_last(), _recent().desc_nulls_last(), F.col("app_id").desc())


def board(applications: DataFrame, listings: DataFrame) -> DataFrame:
    """Board cards: canonical stage and newest-first position in its column.

    Rows, not a list per stage: a column may hold any number of cards. Narrow rows are sorted once by stage and recency; a position
    is a place in that order less the first place of the stage, of which there are six. Cards are joined to their positions.
    """
    stage = canonical_stage(F.col("status")).alias("app_status")
    narrow = applications.join(listings.select(F.col("id").alias("job_id")), "job_id", "left_semi").select(
        F.col("id").alias("app_id"), stage, F.coalesce("updated_at", "created_at").alias("__recent"))
    placed = with_position(narrow, ["app_status", F.col("__recent").desc_nulls_last(), F.col("app_id").desc()])
    firsts = placed.groupBy("app_status").agg(F.min("pos").alias("first"))
    positions = placed.join(F.broadcast(firsts), "app_status").select("app_id", "app_status", (F.col("pos") - F.col("first") + 1).alias("position"))
    return applications_with_listings(applications, listings).drop("app_status").join(positions, "app_id")


def stage_counts(spark: SparkSession, statuses: DataFrame, status: str = "status") -> DataFrame:
    """Cards per stage, zeros included: ``stage_no, stage, n``."""
    counted = statuses.groupBy(canonical_stage(F.col(status)).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame(list(enumerate(STAGES)), "stage_no int, stage string")
    return frame.join(counted, "stage", "left").select("stage_no", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def applied_flags(listings: DataFrame, applications: DataFrame) -> DataFrame:
    """For every listing: is there an application past the ready stage?"""
    known = applications.groupBy(F.col("job_id").alias("id")).agg(F.bool_or(is_past_ready(F.col("status"))).alias("__past"))
    return listings.join(known, "id", "left").withColumn("is_applied", F.coalesce("__past", F.lit(False))).drop("__past")


def display_cards(apps: DataFrame) -> DataFrame:
    """Escaped texts, defaults, shortened dates and usable links for a card or table row."""
    def shown(name: str, default: str):
        return html_escape(F.coalesce(blank_to_null(F.col(name)), F.lit(default)))

    stage = F.coalesce(blank_to_null(F.col("app_status")), F.lit(READY))
    interview = F.when((stage == "Interview Scheduled") & F.col("interview_date").isNotNull(), F.concat(
        F.lit("Interview: "), F.date_format("interview_date", "yyyy-MM-dd HH:mm")))
    applied = F.concat(F.lit("Applied: "), F.date_format("applied_at", "yyyy-MM-dd"))
    return apps.select(
        "app_id", shown("title", "Position").alias("title"), shown("company", "Company").alias("company"),
        shown("platform", "Direct").alias("platform"), shown("location", "Remote").alias("location"),
        shown("salary_range", NOT_SPECIFIED).alias("salary"), stage.alias("stage"),
        score_band(F.col("match_score")).alias("band"), score_label(F.col("match_score")).alias("score_label"),
        F.coalesce(interview, applied).alias("date_badge"),
        F.when(F.startswith("url", F.lit("http")), F.col("url")).alias("link"))


def totals(listings: DataFrame, applications: DataFrame) -> DataFrame:
    """One row: ``n_listings, n_applications``."""
    return listings.agg(F.count(F.lit(1)).alias("n_listings")).select(
        "n_listings", applications.agg(F.count(F.lit(1))).scalar().alias("n_applications"))
