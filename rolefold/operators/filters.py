"""Filters and sort orders of the application table and the listing explorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stages import READY
from ..functions.text import blank_to_null


def text_search(query: str | None, fields: list[str]) -> Column:
    """Case-insensitive substring in any field; a blank query passes everything."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return F.lit(True)
    found = F.lit(False)
    for name in fields:
        found = found | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(wanted))
    return found


def _one_of(col: Column, chosen: list[str] | None) -> Column:
    """None is no filter; an empty list lets nothing through."""
    if chosen is None:
        return F.lit(True)
    return col.isin(chosen) if chosen else F.lit(False)


def filter_applications(
    apps: DataFrame, search: str = "", platforms: list[str] | None = None, stages: list[str] | None = None,
    min_score: int = 0,
) -> DataFrame:
    scored = F.lit(True) if min_score <= 0 else F.coalesce(F.col("match_score") >= min_score, F.lit(False))
    return apps.filter(
        _one_of(F.coalesce(F.col("platform"), F.lit("")), platforms)
        & _one_of(F.coalesce(blank_to_null(F.col("app_status")), F.lit(READY)), stages)
        & scored
        & text_search(search, ["title", "company", "skills", "notes", "match_reasoning"]))


def filter_listings(
    listings: DataFrame, search: str = "", platforms: list[str] | None = None, evaluated: bool | None = None,
) -> DataFrame:
    """Explorer filter. Here an empty platform list means no filter."""
    by_platform = F.coalesce(F.col("platform"), F.lit("")).isin(platforms) if platforms else F.lit(True)
    score = F.col("match_score")
    by_score = F.lit(True) if evaluated is None else score.isNotNull() if evaluated else score.isNull()
    return listings.filter(
        by_platform & by_score & text_search(search, ["title", "company", "description", "skills"]))


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def application_order(by: str) -> list[Column] | None:
    """Sort expressions of one of the table's choices, ties by newest id; None if there is no such choice."""
    recent = F.coalesce("app_updated_at", "app_created_at")
    orders = {
        "Newest First": recent.desc_nulls_last(),
        "Match Score (High to Low)": F.coalesce("match_score", F.lit(0)).desc(),
        "Company (A-Z)": _lower("company").asc(),
        "Title (A-Z)": _lower("title").asc(),
        "Stage": F.coalesce("app_status", F.lit("")).asc(),
    }
    return [orders[by], F.col("app_id").desc()] if by in orders else None


def sort_applications(apps: DataFrame, by: str) -> DataFrame:
    """An unknown choice leaves the rows as they are."""
    order = application_order(by)
    return apps.orderBy(*order) if order else apps


def distinct_platforms(df: DataFrame) -> DataFrame:
    return df.select("platform").filter(F.col("platform") != "").distinct()


def complete_card(df: DataFrame, needs: str) -> DataFrame:
    """Drop cards without the fields a layout requires."""
    has = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    rules = {
        "title+company+url": has("title") & has("company") & has("url"),
        "title+company": has("title") & has("company"),
        "title+url": has("title") & has("url"),
        "short title": has("title") & (F.length("title") <= 100),
    }
    return df.filter(rules[needs])
