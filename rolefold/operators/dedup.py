"""First-wins deduplication and top-n per group.

Both are written as ``row_number() <= n``: Spark limits each group inside every map task before
the shuffle (window group limit), so a key holding a third of the rows sends at most n rows per
task over the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip


def top_n(df: DataFrame, group: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; ``rank`` keeps the position under that name."""
    name = rank or "__rank"
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    limited = df.withColumn(name, position).filter(F.col(name) <= n)
    return limited.withColumn(rank, F.col(rank).cast("bigint")) if rank else limited.drop(name)


def listing_key(platform: str = "platform", job_id: str = "job_id_on_platform") -> list[Column]:
    return [F.lower(strip(F.col(platform))), strip(F.col(job_id))]


def first_wins(df: DataFrame, order: list) -> DataFrame:
    """One row per (platform, id), platform compared without case or surrounding whitespace."""
    platform_key, job_key = listing_key()
    keyed = df.withColumns({"__platform_key": platform_key, "__job_key": job_key})
    return top_n(keyed, ["__platform_key", "__job_key"], order, 1).drop("__platform_key", "__job_key")


def first_per_page(df: DataFrame, page: str, url: str, order: list) -> DataFrame:
    return top_n(df, [page, url], order, 1)
