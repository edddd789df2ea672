"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is one row per block of ``WIDTH`` turns, with a column per position that holds the turn's id: a digest of role and text,
and the bytes of the text. One ``ROLLUP`` over these columns aggregates all prefixes of all blocks together, and ``grouping_id`` tells a
prefix's length. A later block is grouped by ``prior``, the node at which the block before it ends; the last column of a full block holds that
node itself. So a conversation of any length takes part in the same two rollups.

Nodes of earlier blocks are named by digests of digests, ``FAN`` at a time, so naming takes as many rounds as the logarithm of the longest
conversation has digits, and no list is longer than ``FAN``. Turns are numbered by a distributed sort, so one conversation may hold any
share of all turns.

Subtree sums need no walk over the trie. Each node is represented by its smallest member; a conversation carries the sums of what
it represents from each position on, and a node's sum is that over its members: one more ROLLUP.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import with_position
from ..session import materialise

WIDTH = 8            # turns in a block, a column each
FAN = 64             # digests that are digested together
TAIL = 1024          # blocks whose running sums are made in one group
ROOT = "root"
DIGEST_CHARS = 32
CHUNK_IDS = 100_000  # ids in one stretch of a node's list
SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid): the digest of a turn's role and text, followed by the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(told, F.octet_length(text).cast("string")).alias("tid"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, tid): each conversation's turns numbered from 1, null turns first, equal ones in the order of their digests."""
    placed = with_position(_turn_ids(conversations), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid")])
    starts = placed.groupBy("conv_id").agg(F.min("pos").alias("start"))
    return materialise(placed.join(starts, "conv_id").select(
        "conv_id", (F.col("pos") - F.col("start") + 1).alias("place"), "tid"), "turns")


def rebuilt_turns(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations that begin like the first of their family, and (conv_id, n_turns) of all of them, turnless ones included.

    Conversation c takes the first h turns of conversation c - c % ``family`` in place of its own first h, with h = crc32(c) % ``most``. Where that
    conversation has fewer turns, all are taken; where it is absent, none.
    """
    heads = turns.where(F.col("place") < most).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "tid"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "model": F.col("conv_id") - F.col("conv_id") % family})
    convs = convs.join(heads.select(F.col("conv_id").alias("model"), "head"), "model", "left").select(
        "conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)).alias("head"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    convs = materialise(convs.withColumn("taken", F.size("head")), "conversations")
    borrowed = convs.select("conv_id", F.inline("head")).select("conv_id", "place", "tid")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "tid")
    return borrowed.unionByName(own), convs.select("conv_id", (F.col("taken") + F.col("own")).alias("n_turns"))


def _ends_of_blocks(full: DataFrame, blocks: int) -> DataFrame:
    """(conv_id, block, node) from (conv_id, block, digest) of full blocks: ``node`` names all turns up to the block's end.

    Digests are grouped ``FAN`` at a time; complete groups are named the same way one level up.
    """
    group = F.floor(F.col("block") / FAN)
    grouped = full.groupBy("conv_id", group.alias("group")).agg(F.sort_array(F.collect_list(F.struct("block", "digest"))).alias("members"))
    prior = F.lit("")
    if blocks > FAN:
        grouped = materialise(grouped, "block-groups")
        complete = grouped.where(F.size("members") == FAN).select(
            "conv_id", F.col("group").alias("block"), F.md5(F.array_join("members.digest", "").cast("binary")).alias("digest"))
        upper = _ends_of_blocks(complete, -(-blocks // FAN)).select("conv_id", (F.col("block") + 1).alias("group"), F.col("node").alias("prior"))
        grouped, prior = grouped.join(upper, ["conv_id", "group"], "left"), F.coalesce("prior", F.lit(""))
    named = F.transform("members", lambda m, i: F.struct(m["block"].alias("block"), F.md5(F.concat(
        prior, F.array_join(F.slice("members.digest", F.lit(1), i + 1), "")).cast("binary")).alias("node")))
    return grouped.select("conv_id", F.inline(named))


def block_rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per block of a conversation: ``conv_id, block, prior, t1 … , n_turns``; a turnless conversation has an empty first block."""
    place = F.col("place") - 1
    slots = turns.withColumns({"block": F.floor(place / WIDTH), "slot": place % WIDTH}).groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("tid"))).alias(t) for i, t in enumerate(SLOTS)])
    empty = lengths.where("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(t) for t in SLOTS])
    rows = materialise(slots.unionByName(empty).join(lengths, "conv_id"), "blocks")
    last = F.col(SLOTS[-1])
    longest = rows.agg(F.max("block")).first()[0] or 0
    full = rows.where(last.isNotNull()).select("conv_id", "block", F.md5(F.concat(*SLOTS).cast("binary")).alias("digest"))
    ends = materialise(_ends_of_blocks(full, longest + 1), "block-ends")
    rows = rows.join(ends, ["conv_id", "block"], "left").withColumn(
        SLOTS[-1], F.concat("node", F.substring(last, DIGEST_CHARS + 1, 20))).drop("node")
    before = ends.select("conv_id", (F.col("block") + 1).alias("block"), F.col("node").alias("prior"))
    # Conversations of one block need no node before it.
    later = rows.where("block > 0").join(before, ["conv_id", "block"])
    first = rows.where("block = 0").withColumn("prior", F.lit(ROOT))
    return materialise(first.unionByName(later), "trie-blocks")


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """All nodes: a block's prefixes by ROLLUP, with their depth; a prefix longer than its conversations is none."""
    slots = ", ".join(SLOTS)
    found = blocks.sparkSession.sql(f"""
        SELECT block, prior, {slots}, {WIDTH} - bit_count(grouping_id()) AS d, count(*) AS n_convs, min(conv_id) AS conv_id, {sums}
        FROM {{blocks}} GROUP BY block, prior, ROLLUP({slots})""", blocks=blocks)
    return found.where(F.when(F.col("d") == 0, F.col("block") == 0).otherwise(_last().isNotNull())).withColumn(
        "depth", F.col("block") * WIDTH + F.col("d"))


def _last() -> Column:
    return F.element_at(F.array(*SLOTS), F.greatest(F.col("d"), F.lit(1)).cast("int"))


def _node(slots: list[str]) -> Column:
    """Name of the node at which these columns end, for rows that are null from there on."""
    return F.when(F.col(SLOTS[-1]).isNotNull() if SLOTS[-1] in slots else F.lit(False), F.substring(SLOTS[-1], 1, DIGEST_CHARS)).when(
        F.col("t1").isNull(), F.col("prior")).otherwise(F.md5(F.concat_ws("|", "prior", *slots).cast("binary")))


def _carried(blocks: DataFrame) -> DataFrame:
    """``blocks`` with s1 …, what a conversation represents from each position on, and ``leaf``, whether it represents its end."""
    nodes = _rolled(blocks, "max(n_turns) AS longest").where("d > 0").select(
        "conv_id", "block", "d", ((F.col("n_convs") - 1) * F.substring(_last(), DIGEST_CHARS + 1, 20).cast("long")).alias("own"),
        (F.col("longest") == F.col("depth")).cast("long").alias("leaf"))
    own = materialise(nodes.groupBy("conv_id", "block").agg(
        *[F.sum(F.when(F.col("d") == i, F.col("own")).otherwise(0)).alias(f"o{i}") for i in range(1, WIDTH + 1)], F.sum("own").alias("total"),
        F.sum("leaf").alias("leaf")), "trie-own")
    # What a block's later blocks hold: running sums within groups of blocks, and over the groups.
    long = blocks.where(F.col("n_turns") > WIDTH).select("conv_id", "block").join(own.select("conv_id", "block", "total", "leaf"), ["conv_id", "block"], "left")
    long = materialise(long.withColumn("group", F.floor(F.col("block") / TAIL)).fillna(0, ["total", "leaf"]), "trie-long")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    within, across = after.partitionBy("conv_id", "group"), Window.partitionBy("conv_id").orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, -1)
    groups = long.groupBy("conv_id", "group").agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf")).select(
        "conv_id", "group", *[F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"far_{c}") for c in ("total", "leaf")])
    tails = long.select("conv_id", "block", "group", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"near_{c}") for c in ("total", "leaf")]).join(
        groups, ["conv_id", "group"]).select("conv_id", "block", *[(F.col(f"near_{c}") + F.col(f"far_{c}")).alias(f"after_{c}") for c in ("total", "leaf")])
    joined = blocks.join(own, ["conv_id", "block"], "left").join(tails, ["conv_id", "block"], "left")
    joined = joined.fillna(0, ["leaf", "after_leaf", "after_total", *[f"o{i}" for i in range(1, WIDTH + 1)]])
    sums = {}
    for i in range(WIDTH, 0, -1):
        sums[f"s{i}"] = sums.get(f"s{i + 1}", F.col("after_total")) + F.col(f"o{i}")
    # A turnless conversation is a leaf only where nobody has a turn; the caller sees to the root.
    return joined.withColumns(sums).withColumn("leaf", F.col("leaf") + F.col("after_leaf")).select(*blocks.columns, "leaf", *[f"s{i}" for i in range(1, WIDTH + 1)])


def trie_nodes(blocks: DataFrame) -> DataFrame:
    """One row per node: ``node, parent, depth, turn_id, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``.

    ``turn_id`` is the digest of the node's last turn where its block does not end there. The root has no parent; without conversations there is no root.
    """
    rolled = _rolled(_carried(blocks), ", ".join(["sum(leaf) AS n_leaves", *[f"sum(s{i}) AS s{i}" for i in range(1, WIDTH + 1)]]))
    shorter = F.array(F.col("prior"), *[_node(SLOTS[:i]) for i in range(1, WIDTH)])
    nodes = materialise(rolled.select(
        _node(SLOTS).alias("node"), F.when(F.col("d") > 0, F.element_at(shorter, F.greatest(F.col("d"), F.lit(1)).cast("int"))).alias("parent"),
        F.col("depth").cast("long").alias("depth"), F.when(F.col("d").between(1, WIDTH - 1), F.substring(_last(), 1, DIGEST_CHARS)).alias("turn_id"),
        "conv_id", "n_convs", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        F.element_at(F.array(*[f"s{i}" for i in range(1, WIDTH + 1)]), F.greatest(F.col("d"), F.lit(1)).cast("int")).alias("saved_tokens")), "trie-nodes")
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").join(children, "node", "left").select(
        "node", "parent", "depth", "turn_id", "conv_id", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def node_ends(blocks: DataFrame) -> DataFrame:
    """(node, conv_id): where each conversation ends."""
    last = F.col("block") == F.greatest(F.floor((F.col("n_turns") - 1) / WIDTH), F.lit(0))
    return blocks.where(last).select(_node(SLOTS).alias("node"), "conv_id")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as (node, part, place, ids): decimal ids joined by commas, at most ``CHUNK_IDS`` at a time."""
    part, place, node, ids = TaskContext.get().partitionId(), 0, None, []

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["node", "part", "place", "ids"])

    rows = []
    for batch in batches:
        for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != node or len(ids) == CHUNK_IDS):
                rows.append((node, part, place, ",".join(ids)))
                place, ids = place + 1, []
            node = own
            ids.append(str(conv))
        if rows:
            yield packed(rows)
            rows = []
    if ids:
        yield packed([(node, part, place, ",".join(ids))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sha256) from stretches in order; one running hash is all that is kept."""
    node, running = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if own == node:
                running.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, running.hexdigest()))
            node, running = own, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["node", "sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], ["node", "sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, sha256) of each node's decimal ids in ascending order, joined by commas.

    A SHA-256 is one chain, so its last step is one task for a node, which reads stretches one by one; the sort and the making of text are spread over all tasks.
    """
    stretches = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        _stretches, "node string, part long, place long, ids string")
    return materialise(stretches, "end-stretches").repartition("node").sortWithinPartitions("node", "part", "place").select("node", "ids").mapInArrow(
        _hashed, "node string, sha256 string")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (see ``rebuilt_turns``), with the digest of the members that end at each.

    Rows without a conv_id belong to no conversation and are left out. Null roles and texts are empty ones; turns with equal numbers follow
    each other by the digest of role and text, so repeated rows are repeated turns. Texts of any length are read whole and never shuffled; other columns are ignored.
    An empty table gives no rows, not even a root.
    """
    turns, lengths = rebuilt_turns(numbered_turns(conversations))
    blocks = block_rows(turns, lengths)
    return trie_nodes(blocks).join(ends_digests(node_ends(blocks)), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
