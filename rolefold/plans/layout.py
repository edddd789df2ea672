"""Which of a store's files count: a log of what was done, and a filter on partition folders that follows from it.

Rows lie in folders ``gen=…/…/platform_key=…/``, ``gen`` being the store's version when they were written. A purge or reset adds a row to the log and raises
the version; it writes, copies and deletes no table file. Readers leave out, by their folders, the platforms that were purged after a folder was written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import read_or_empty

LOG = "version int, kind string, platforms array<string>, value long"


@dataclass
class Layout:
    version: int = 0
    buckets: int | None = None
    reset_at: int = 0                       # nothing older counts
    purges: list[tuple[int, list[str]]] = field(default_factory=list)
    values: dict[str, int] = field(default_factory=dict)

    def visible(self) -> Column:
        """On ``gen`` and ``platform_key`` alone, so that Spark prunes folders by it."""
        seen = F.col("gen") >= self.reset_at
        for version, platforms in self.purges:
            if version > self.reset_at:
                gone = F.col("platform_key").isin(platforms) & (F.col("gen") < version)
                seen = seen & ~F.coalesce(gone, F.lit(False))
        return seen


def read_layout(spark: SparkSession, root: str) -> Layout:
    """One row per call that changed the store, so the driver may hold them."""
    found = Layout()
    rows = sorted(read_or_empty(spark, f"{root}/versions", LOG).select("version", "kind", "platforms", "value").collect(), key=lambda r: r["version"])
    for row in rows:
        found.version = max(found.version, row["version"])
        if row["kind"] == "reset":
            # Ids start again.
            found.reset_at, found.values = row["version"], {k: v for k, v in found.values.items() if k == "epoch"}
        elif row["kind"] == "purge":
            found.purges.append((row["version"], list(row["platforms"])))
        elif row["kind"] == "buckets":
            found.buckets = row["value"]
        else:
            found.values[row["kind"]] = max(found.values.get(row["kind"], 0), row["value"])
    return found


def log_rows(spark: SparkSession, root: str, version: int, *rows: tuple[str, list[str] | None, int | None]) -> None:
    """Add (kind, platforms, value) rows, all or none of them."""
    told: DataFrame = spark.createDataFrame([(version, *row) for row in rows], LOG)
    told.coalesce(1).write.mode("append").parquet(f"{root}/versions")
