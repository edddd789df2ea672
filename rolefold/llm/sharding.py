"""Contiguous shards of nearly equal bytes that never split a group of equal texts.

Groups of equal texts stand in the order of a 128-bit digest of their text, so that order does not depend
on how rows are stored. The smallest feasible shard capacity over that sequence is found by binary search
with a greedy check, and the shards are cut there.

The sequence itself never leaves the executors. The driver sees the bytes of digest prefixes: at first
of all 4,096 three-digit prefixes, then of longer prefixes, but only below those that may still hold a cut.
An optimistic check lets blocks be split anywhere, a cautious one nowhere; where both give the same capacity,
it is the exact one. At most about 16 x 16 blocks stay open per level, whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise

FIRST_DIGITS, MORE_DIGITS, DIGEST_DIGITS = 3, 2, 32
SLOT_BUCKETS = 1024


class _Blocks:
    """Ordered blocks of groups: prefix, bytes, number of groups, and running bytes."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if self.ends else 0

    def cautious(self, start: int, capacity: int) -> int:
        """Farthest end of a whole block within the capacity."""
        k = bisect_right(self.ends, start + capacity)
        return self.ends[k - 1] if k else 0

    def optimistic(self, start: int, capacity: int) -> int:
        """As ``cautious``, but a block of several groups may be cut anywhere."""
        end = start + capacity
        k = bisect_right(self.ends, end)
        if k < len(self.rows) and self.rows[k][2] > 1:
            return end
        return max(start, self.ends[k - 1] if k else 0)

    def cuts(self, shards: int, capacity: int, step) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = step(at, capacity)
            out.append(at)
        return out

    def smallest(self, shards: int, step) -> int:
        """Binary search of the smallest capacity with which the greedy check reaches the end."""
        low = max([-(-self.total // shards), *(r[3] for r in self.rows)], default=0)
        high = max(self.total, low)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(shards, middle, step)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def _block_rows(groups: DataFrame, digits: int, within: list[str] | None) -> list[tuple[str, int, int, int]]:
    """Bytes, number of groups and largest group by prefix; bounded by the number of prefixes asked for."""
    prefix = F.substring("digest", 1, digits)
    if within is not None:
        groups = groups.where(F.substring("digest", 1, len(within[0])).isin(within))
    rows = groups.groupBy(prefix.alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest"))
    return [tuple(r) for r in rows.collect()]


def _search(groups: DataFrame, shards: int) -> tuple[_Blocks, int]:
    """Blocks that are fine enough for the exact smallest capacity, and that capacity."""
    digits = FIRST_DIGITS
    blocks = _Blocks(_block_rows(groups, digits, None))
    while True:
        low, high = blocks.smallest(shards, blocks.optimistic), blocks.smallest(shards, blocks.cautious)
        if low == high or digits >= DIGEST_DIGITS:
            return blocks, high
        first, last = blocks.cuts(shards, low, blocks.cautious), blocks.cuts(shards, high, blocks.optimistic)
        open_ = {
            i for a, z in zip(first, last)
            for i in range(bisect_right(blocks.ends, a), min(len(blocks.rows), bisect_left(blocks.ends, z) + 1))
            if blocks.rows[i][2] > 1}
        if not open_:
            return blocks, high
        # Blocks of different depth may be open; each depth is asked for once.
        found = []
        for depth in sorted({len(blocks.rows[i][0]) for i in open_}):
            within = [blocks.rows[i][0] for i in open_ if len(blocks.rows[i][0]) == depth]
            found += _block_rows(groups, depth + MORE_DIGITS, within)
            digits = max(digits, depth + MORE_DIGITS)
        blocks = _Blocks([r for i, r in enumerate(blocks.rows) if i not in open_] + found)


def _cut_keys(blocks: _Blocks, capacity: int, shards: int) -> list[str]:
    """Prefix at which each shard but the first begins.

    Every cut between the latest start from which the rest still fits and the farthest end within the capacity keeps
    to the capacity. Of these the one nearest to an even share is taken, so that one huge group does not leave the
    shards after it empty.
    """
    ends, total = blocks.ends, blocks.total
    earliest, at = [0] * (shards + 1), total
    earliest[shards] = total
    for s in range(shards - 1, 0, -1):
        k = bisect_left(ends, at - capacity)
        at = 0 if at - capacity <= 0 else ends[k]
        earliest[s] = at
    keys, at = [], 0
    for s in range(1, shards):
        far = min(at + capacity, total)
        want = at + (total - at) / (shards - s + 1)
        k = bisect_left(ends, want)
        choices = [e for e in ([0] + ends[max(0, k - 1):k + 1]) if max(at, earliest[s]) <= e <= far]
        cut = min(choices, key=lambda e: abs(e - want)) if choices else max(
            ends[bisect_right(ends, far) - 1] if bisect_right(ends, far) else 0, at)
        if want < earliest[s]:
            cut = max(earliest[s], at)
        at = cut
        k = bisect_right(ends, at)
        keys.append(blocks.rows[k][0] if k < len(blocks.rows) else "~")
    return keys


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of ``docs``.

    A row's size is the UTF-8 bytes of its text plus 1. Null texts count as empty ones (size 1, checksum 0) and are one
    group with them. Equal texts always share a shard; repeated rows and null ids are rows like others. Fewer groups
    than shards leave shards empty; an empty table gives no rows. Slots number a shard's rows from 0 without gaps, in an order that
    depends on ids and texts alone. Other columns are ignored. The law is ``bytes``, so ``grown_shard`` is null.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text.cast("binary"), 256), 1, DIGEST_DIGITS).alias("digest"),
    ), "shard-rows")
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    blocks, capacity = _search(groups, shards)
    shard = F.lit(0)
    for key in _cut_keys(blocks, capacity, shards):
        shard = shard + (F.col("digest") >= key).cast("int")
    rows = rows.withColumn("shard", shard.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLOT_BUCKETS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x SLOT_BUCKETS rows, whatever the input.
    offsets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")) - 1
    return rows.withColumn("place", place).join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
