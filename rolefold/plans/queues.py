"""Work queues over stored listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recency():
    return F.coalesce("scraped_at", "created_at")


def not_applied(listings: DataFrame, applications: DataFrame) -> DataFrame:
    """Listings without an application. An application lacking a job id excludes nothing."""
    applied = applications.select(F.col("job_id").alias("id"))
    return listings.join(applied, "id", "left_anti")


def waiting_for_score(listings: DataFrame, applications: DataFrame) -> DataFrame:
    """Scraped, not scored, not applied; in no order."""
    return not_applied(
        listings.filter((F.col("status") == "scraped") & F.col("match_score").isNull()), applications)


def good_matches(listings: DataFrame, applications: DataFrame, min_score: int = 70) -> DataFrame:
    """Scored at least ``min_score``, not applied; in no order."""
    return not_applied(listings.filter(F.col("match_score") >= min_score), applications)


def _first(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered.limit(limit) if limit is not None else ordered


def pending_queue(listings: DataFrame, applications: DataFrame, limit: int | None = None) -> DataFrame:
    """What waits for a score, newest first."""
    return _first(waiting_for_score(listings, applications), [recency().desc_nulls_last(), F.col("id").desc()], limit)


def candidate_queue(
    listings: DataFrame, applications: DataFrame, min_score: int = 70, limit: int | None = None,
) -> DataFrame:
    """Good matches, best first, then newest."""
    order = [F.col("match_score").desc(), recency().desc_nulls_last(), F.col("id").desc()]
    return _first(good_matches(listings, applications, min_score), order, limit)


def all_listings(listings: DataFrame, newest_first: bool = True) -> DataFrame:
    if newest_first:
        return listings.orderBy(recency().desc_nulls_last(), F.col("id").desc())
    return listings.orderBy(recency().asc_nulls_last(), F.col("id").asc())
