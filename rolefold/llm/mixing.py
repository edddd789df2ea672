"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mixture consists of equal blocks of words. The blocks go to the sources with the highest quotients
target / 1, target / 3, target / 5, …; the apportionments of the first 1/M, 2/M, … of all blocks are nested, and
their differences are the integer quotas of the M shards. A source's words form an endless stream: its
documents in a seeded order, again and again. Its quotas are cut from that stream block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .common import n_words, source_key

WEIGHTS = (5, 2, 1)
MOST = 3                    # a source's target is at most so many times its size
BLOCKS = 1_000_000          # blocks that the mixture has at least, if it has so many words
BLOCKS_OF_SMALLEST = 200    # blocks that the smallest target has at least
BUCKETS = 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to rows (key, source_size), one per source.

    Sources take the weights in turn, by code point, the null source last. Targets share out all words by weight; what would exceed
    ``most`` times a source's size is shared among the others. The level at which this ends is found in one pass over the
    sources in the order of the level that fills them.
    """
    ranked = Window.orderBy(F.col("key") == "n", "key")
    by_level = Window.orderBy("level", "key")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("double")).withColumn(
        "cap", (F.col("source_size") * most).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    full_before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("words", F.sum("source_size").over(everything)).withColumn(
        "reached", (F.col("words") - full_before) / weight_left)
    first = F.min(F.when(F.col("level") > F.col("reached"), F.struct("level", "key", "reached"))).over(everything)
    return rows.withColumn("stop", first["reached"]).withColumn(
        "target", F.coalesce(F.least("cap", F.col("stop") * F.col("weight")), F.col("cap")))


def quotas(sources: DataFrame, shards: int, most: int = MOST) -> DataFrame:
    """Adds ``block`` and ``ends`` to rows with ``target``: words per block, and blocks that a source gives to the first 1 … shards shards.

    Quotients far above the last one granted need not be ranked: the quotas differ from rounded shares by less than
    the source's part of the number of sources. So about four rows per source and shard are ranked.
    """
    everything = Window.partitionBy()
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    rows = sources.withColumn("n_sources", F.count(F.lit(1)).over(everything)).withColumn("block", F.greatest(F.lit(1), F.least(
        F.floor(F.col("words") / BLOCKS), F.floor(F.coalesce(smallest, F.lit(0.0)) / BLOCKS_OF_SMALLEST))).cast("long"))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn(
        "house", F.floor(F.floor(F.col("words") / F.col("block")) * F.col("shard") / shards).cast("long"))
    share = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    at_most = F.floor(F.col("source_size") * most / F.col("block")).cast("long")
    rows = rows.withColumn("slack", (F.ceil(share * F.col("n_sources")) + 1).cast("long")).withColumn("at_most", at_most).withColumn(
        "sure", F.least("at_most", F.greatest(F.lit(0), F.floor(share * F.col("house") + 0.5) - F.col("slack")).cast("long")))
    house = Window.partitionBy("shard")
    rows = rows.withColumn("open", F.col("house") - F.sum("sure").over(house))
    ranked = rows.select("key", "shard", "open", "at_most", "target", F.explode(
        F.sequence(F.col("sure") + 1, F.col("sure") + 2 * F.col("slack") + 1)).alias("seat")).where("seat <= at_most and target > 0")
    place = F.row_number().over(house.orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), "key", "seat"))
    granted = ranked.withColumn("place", place).where("place <= open").groupBy("key", "shard").agg(F.count(F.lit(1)).alias("granted"))
    rows = rows.join(granted, ["key", "shard"], "left").withColumn("quota", F.col("sure") + F.coalesce("granted", F.lit(0)))
    return rows.groupBy("key", "source_size", "target", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("ends"))


def _words_until(end: Column, length: Column, start: Column, size: Column) -> Column:
    """Words of a document among the first ``end`` words of its source's endless stream."""
    rounds = F.floor(end / length)
    rest = end - rounds * length
    return rounds * size + F.greatest(F.lit(0), F.least(size, rest - start))


def mix_sources(docs: DataFrame, seed: int = 17, shards: int = 16, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_rows: bool = False) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, taken_by_shard), one per row of ``docs``.

    With ``whole_rows``, rows are (size, taken, row) instead, with all columns of ``docs`` in ``row``.

    ``taken`` counts the words that the mixture takes from a document, repeats included. Null and empty texts have size 0
    and give nothing; null sources are one source. Sources without words have target 0. Rows that repeat are taken like others; rows
    with equal ids stand in the order of their sizes. No words at all, or no rows, give targets of 0. Other columns are ignored.
    Each source's taken words differ from its target by about a block: a millionth of all words or half a percent
    of the smallest target, whichever is less, and at least one word.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.octet_length(text_col))
    kept = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if whole_rows else []
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), n_words(F.col(text_col)).alias("size"),
        order.alias("place"), *kept,
    ).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int")), "mix-rows")
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    by_source = buckets.groupBy("key").agg(F.sum("words").alias("source_size"))
    plan = quotas(targets(by_source, weights, most), shards, most)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(plan, "key")
    # A source is dealt out by bucket, so that a third of all rows in one source is still many small windows.
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("until", F.sum("size").over(inside)).join(offsets, ["key", "bucket"])
    start = F.col("before") + F.col("until") - F.col("size")
    ends = F.transform("ends", lambda q: F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        _words_until(q * F.col("block"), F.col("source_size"), F.col("start"), F.col("size"))).cast("long"))
    placed = placed.withColumn("start", start).withColumn("until_shard", ends)
    taken = F.element_at("until_shard", -1)
    by_shard = F.transform("until_shard", lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get("until_shard", i - 1)))
    if whole_rows:
        return placed.select("size", taken.alias("taken"), "row")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("taken_by_shard"))
