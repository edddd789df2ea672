"""The whole run: collect → store → score → tailor → record."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.lexicon import SKILL_LEXICON, Lexicon
from ..functions.text import keyword_terms
from ..operators.coverage import resume_profile, score_listings
from ..operators.lifecycle import created_events
from ..operators.ordering import with_position
from ..operators.tailoring import rendered, tailor
from ..schemas import RESUME, RUN_METRICS
from ..sources.resumes import resolve_resume, with_structure
from ..sources.registry import SourcesFailed, collect_listings, no_listings
from .queues import candidate_queue, good_matches, pending_queue, waiting_for_score
from .store import ListingStore, counted

DEFAULT_KEYWORDS = "Software Engineer, Data Engineer"  # fixed value
PIPELINE_NOTE = "Auto-tailored by pipeline"  # fixed value
RESUME_FIELDS = [f for f in RESUME.fieldNames() if f != "resume_id"]


def resume_text(resumes: DataFrame) -> DataFrame:
    """The text a résumé is scored by: its raw text, else its JSON form."""
    raw = F.col("raw_text") if "raw_text" in resumes.columns else F.lit(None).cast("string")
    return resumes.select(F.coalesce(raw, F.to_json(F.struct(*[
        c for c in resumes.columns if c in RESUME_FIELDS]))).alias("text"))


def evaluate_pending(
    store: ListingStore, resume: DataFrame, now: Column, limit: int | None = None, lexicon: Lexicon = SKILL_LEXICON,
) -> int:
    """Score the pending queue against one résumé; returns how many listings were scored."""
    listings, applications = store.listings(), store.applications()
    # Without a limit the order does not matter, so nothing is sorted.
    queue = (waiting_for_score(listings, applications) if limit is None
             else pending_queue(listings, applications, limit))
    profile = resume_profile(resume_text(resume), lexicon=lexicon)
    scores, seen = counted(score_listings(queue, "id", "description", profile), "scores")
    store.apply_scores(scores.select(
        F.col("id").alias("job_id"), F.col("score").alias("match_score"), F.col("reasoning").alias("match_reasoning")), now)
    return seen.get("n", 0)


def tailor_candidates(
    store: ListingStore, resume: DataFrame, now: Column, min_score: int = 70, limit: int | None = None,
) -> int:
    """Create a ready application with a tailored résumé for each candidate listing."""
    listings, applications = store.listings(), store.applications()
    queue = (good_matches(listings, applications, min_score) if limit is None
             else candidate_queue(listings, applications, min_score, limit))
    # Ids are given to the bare keys; the wide rows are made and written in a single pass.
    numbered = with_position(queue.select("id"), [F.col("id")])
    # The single résumé row becomes a literal of the plan; no join is involved.
    fields = [c for c in resume.columns if c in [*RESUME_FIELDS, "raw_text"]]
    one = resume.select(F.struct(*fields)).scalar()
    first = store.next_event_id()
    shaped = queue.join(numbered, "id").select(
        F.col("id").alias("job_id"), (F.col("pos") + first).alias("event_id"), "title", "company", "description",
        "platform_key", one.alias("r")).select("job_id", "event_id", "title", "company", "description", "platform_key", "r.*")
    shaped = shaped.withColumns({
        f.name: F.coalesce(F.col(f.name) if f.name in fields else F.lit(None), F.array()).cast(f.dataType)
        if f.dataType.typeName() == "array" else (F.col(f.name) if f.name in fields else F.lit(None)).cast(f.dataType)
        for f in RESUME.fields if f.name in RESUME_FIELDS})
    made = tailor(shaped)
    done = made.select(
        "job_id", "event_id", F.col("event_id").alias("application_id"),
        F.to_json(F.struct(*RESUME_FIELDS, *[c for c in fields if c == "raw_text"])).alias("resume_json"), rendered(made).alias("resume_html"),
        F.lit(PIPELINE_NOTE).alias("notes"), "platform_key")
    seen = Observation()
    store.append_events(created_events(done, now).observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get.get("n", 0)


def run_campaign(
    spark: SparkSession,
    store: ListingStore,
    landed: dict[str, DataFrame | Callable[[], DataFrame]],
    now: Column,
    resume: DataFrame | None = None,
    keywords: list[str] | str | None = None,
    min_score: int = 70,
    limit_per_source: int | None = None,
    enabled_sources: list[str] | None = None,
    evaluate_limit: int | None = None,
    tailor_limit: int | None = None,
    lexicon: Lexicon = SKILL_LEXICON,
) -> DataFrame:
    """One row of run metrics. A failing source and the items of a source that cannot be read are listed under ``errors``; the run goes on.

    Where all sources fail, what is stored is still scored, and the status is ``failed``.
    """
    resume = resolve_resume(spark) if resume is None else with_structure(resume)
    wanted = keyword_terms(keywords or DEFAULT_KEYWORDS)
    try:
        (found, errors), status = collect_listings(landed, spark, wanted, limit_per_source, enabled_sources), "success"
    except SourcesFailed as failure:
        found, errors, status = no_listings(spark), failure.errors, "failed"
    found, seen = counted(found, "collected")
    stored = store.upsert_listings(found, now, ["source_no", "unit", "pos"])
    new = stored.filter("is_new").count()
    evaluated = evaluate_pending(store, resume, now, evaluate_limit, lexicon)
    ready = tailor_candidates(store, resume, now, min_score, tailor_limit)
    row = (uuid.uuid4().hex, seen.get("n", 0), new, evaluated, ready, status, errors, None)
    metrics = spark.createDataFrame([row], RUN_METRICS).withColumn("finished_at", now.cast("timestamp"))
    metrics.write.mode("append").parquet(f"{store.root}/metrics")
    return metrics
