"""Order-dependent operators that stay balanced when one group is very large.

A window over a group runs in one task, however large the group is. Here ``with_position`` numbers all
rows by one distributed sort, fixed-size blocks of consecutive rows take the place of the
groups, and only one row per block crosses block borders. There is no other path for small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

BLOCK_ROWS = 1_000_000    # rows per block, unless the session sets spark.rolefold.blockRows


def with_position(df: DataFrame, order: list, out: str = "pos") -> DataFrame:
    """Consecutive numbers from 0 in the given total order, without a single-task window.

    Sorted rows are written out once, so that both the per-partition counts and the numbering
    read the same partitions.
    """
    local = "__local"
    placed = materialise(
        df.orderBy(*order).withColumn(local, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(F.col(local), 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per partition of the sort: its number is bounded by the shuffle partition setting.
    offsets = sizes.select("__part", F.coalesce(
        F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__offset"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__offset") + F.col(local).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__offset", local)
    )


class GroupOrder:
    r"""Rows in a total order inside groups; operators can be chained on one ordering.

    >>> GroupOrder(events, ["application_id"], [F.col("created_at"), F.col("event_id")]) \
    ...     .lag({"stage": "previous_stage"}).rank("seq").result()
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list, block_rows: int | None = None):
        self.keys = keys
        block_rows = block_rows or int(df.sparkSession.conf.get("spark.rolefold.blockRows", str(BLOCK_ROWS)))
        placed = with_position(df, [*[F.col(k) for k in keys], *order], "__pos")
        self.rows = placed.withColumn("__block", F.floor(F.col("__pos") / block_rows))
        self.window = Window.partitionBy("__block").orderBy("__pos")

    def result(self) -> DataFrame:
        return self.rows.drop("__pos", "__block")

    def _keep(self, rows: DataFrame, added: list[str]) -> GroupOrder:
        self.rows = rows.select(*[c for c in self.rows.columns if c not in added], *added)
        return self

    def _same_keys(self, prefix: str) -> Column:
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(prefix + k))
        return same

    def _carry_from(self, edges: DataFrame, values: dict[str, Column]) -> DataFrame:
        """One row per block, addressed to the block after it."""
        return edges.select((F.col("__block") + 1).alias("__block"),
                            *[F.col(k).alias(f"__carry_{k}") for k in self.keys],
                            *[c.alias(f"__carry_{v}") for v, c in values.items()])

    def lag(self, values: dict[str, str]) -> GroupOrder:
        """The previous row's value inside the group: input column → output column."""
        last_rows = self.rows.groupBy("__block").agg(
            F.max_by(F.struct(*self.keys, *values), "__pos").alias("__edge")).select("__block", "__edge.*")
        carry = self._carry_from(last_rows, {src: F.col(src) for src in values})
        inner = self.rows.withColumns({
            **{f"__prev_{k}": F.lag(k).over(self.window) for k in self.keys},
            **{out: F.lag(src).over(self.window) for src, out in values.items()},
            "__first": F.row_number().over(self.window) == 1,
        }).join(carry, "__block", "left")
        first = F.col("__first")
        return self._keep(inner.withColumns({
            out: F.when(~first & self._same_keys("__prev_"), F.col(out)).when(
                first & self._same_keys("__carry_"), F.col(f"__carry_{src}"))
            for src, out in values.items()
        }), list(values.values()))

    def fill(self, values: dict[str, str]) -> GroupOrder:
        """The latest non-null value up to and including each row."""
        # Per block: the keys of its last row and the last non-null values of that key's run.
        edge = self.rows.groupBy("__block", *self.keys).agg(
            F.max("__pos").alias("__end"),
            *[F.max_by(src, F.when(F.col(src).isNotNull(), F.col("__pos"))).alias(src) for src in values])
        last_run = edge.groupBy("__block").agg(
            F.max_by(F.struct(*self.keys, *values), "__end").alias("__edge")).select("__block", "__edge.*")
        # A key's run may span several blocks: its values are handed on from block to block.
        along = Window.partitionBy(*self.keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
        carry = self._carry_from(last_run, {src: F.last(src, ignorenulls=True).over(along) for src in values})
        upto = Window.partitionBy("__block", *self.keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
        inner = self.rows.withColumns({
            out: F.last(src, ignorenulls=True).over(upto) for src, out in values.items()}).join(carry, "__block", "left")
        return self._keep(inner.withColumns({
            out: F.coalesce(F.col(out), F.when(self._same_keys("__carry_"), F.col(f"__carry_{src}")))
            for src, out in values.items()
        }), list(values.values()))

    def rank(self, out: str) -> GroupOrder:
        """1-based position inside the group."""
        keys = F.struct(*self.keys)
        starts = self.rows.groupBy("__block", *self.keys).agg(F.min("__pos").alias("__start"))
        heads = starts.groupBy("__block").agg(
            F.min_by(keys, "__start").alias("__head"), F.max_by(keys, "__start").alias("__tail"),
            F.max("__start").alias("__tail_start"), F.count(F.lit(1)).alias("__runs"))
        # One row per block from here on. A block whose head continues the tail before it looks up
        # where that run began; a block that is all one such run passes the beginning on.
        back = Window.orderBy("__block")
        linked = heads.withColumn("__continues", F.coalesce(
            F.col("__head").eqNullSafe(F.lag("__tail").over(back)), F.lit(False)) & (F.col("__block") > 0))
        began = F.when(~(F.col("__continues") & (F.col("__runs") == 1)), F.col("__tail_start"))
        carry = linked.withColumn("__began", began).withColumn("__open", F.last("__began", ignorenulls=True).over(
            back.rowsBetween(Window.unboundedPreceding, -1))).filter("__continues").select(
            "__block", F.col("__head").alias("__carry_key"), "__open")
        inner = self.rows.withColumn(
            "__start", F.min("__pos").over(Window.partitionBy("__block", *self.keys))).join(carry, "__block", "left")
        start = F.when(keys.eqNullSafe(F.col("__carry_key")), F.col("__open")).otherwise(F.col("__start"))
        return self._keep(inner.withColumn(out, F.col("__pos") - start + 1), [out])


def lag_within(df: DataFrame, keys: list[str], order: list, values: dict[str, str], block_rows: int | None = None) -> DataFrame:
    return GroupOrder(df, keys, order, block_rows).lag(values).result()


def rank_within(df: DataFrame, keys: list[str], order: list, out: str, block_rows: int | None = None) -> DataFrame:
    return GroupOrder(df, keys, order, block_rows).rank(out).result()


def fill_forward(df: DataFrame, keys: list[str], order: list, values: dict[str, str], block_rows: int | None = None) -> DataFrame:
    return GroupOrder(df, keys, order, block_rows).fill(values).result()
