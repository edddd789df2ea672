"""Row-level helpers: computing a column once, and using all cores on a small scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body) -> Column:
    """Bind an expression once and use it several times inside one row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns whose expressions are evaluated exactly once per row.

    A filter on an ordinary derived column is pushed below the projection and takes a copy of the
    expression with it, once per mention. Generated columns stay where they are.
    """
    kept = df.columns if keep is None else keep
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*[c for c in kept if c not in columns], F.inline(one))


def spread(scan: DataFrame) -> DataFrame:
    """Distribute a scan that has clearly fewer partitions than the cluster has cores.

    Heavy per-row work on one small file would otherwise run in a single task. Spark cuts scans
    into at least as many pieces as there are cores once they exceed 4 MB per core, so only tables
    below that size are ever shuffled here; anything larger is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() <= cores - max(1, cores // 8) else scan
