"""Removing the listings of discontinued sources together with what refers to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

DEPRECATED_PLATFORMS = ["remoteok", "weworkremotely"]  # fixed values


def is_deprecated(platform: Column, names: list[str] = DEPRECATED_PLATFORMS) -> Column:
    return F.lower(platform).isin([n.lower() for n in names])


@dataclass
class Purged:
    listings: DataFrame
    applications: DataFrame
    timeline: DataFrame
    removed: DataFrame  # the listings that went, one row each


def purge_cascade(
    listings: DataFrame, applications: DataFrame, timeline: DataFrame, doomed: Column,
) -> Purged:
    """``doomed`` is a predicate on listings. Rows that refer to a doomed one go with it."""
    gone = listings.filter(doomed)
    gone_apps = applications.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return Purged(
        listings.filter(~F.coalesce(doomed, F.lit(False))),
        applications.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti"),
        timeline.join(gone_apps.select(F.col("id").alias("application_id")), "application_id", "left_anti"),
        gone)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.filter(F.col(child_key).isNotNull()).join(
        parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
