"""Near-duplicate components by a chosen-path set similarity join.

Documents become sets of word shingles, sets become MinHash sketches. In each of several independent trees a document
descends from the root: a node selects one coordinate, and with probability 1/threshold - 1 a second one, and its
documents branch by their MinHash value there. Nodes of at most ``SMALL`` documents are compared exhaustively on their sketches; larger ones
branch again. Two sets of similarity J share a path of depth d with a probability of J^d at least, and
the trees are independent: at J = 0.85, twelve trees lose a pair that is compared at depth 2 or 3 about once in 100,000 times.

A large node most of whose documents would go on together, or that is still large at the last depth, is a crowd of near copies. It is
compared in chunks, and all its documents with its most central ones, so no task sees more than a chunk. This is only the first round.

Candidates are confirmed on full sets. As only components are asked for, a document's most promising edge is confirmed
first, and of the others only those between different components. Nodes of which the first round took a part of the pairs, and all crowds,
are then gone through again with the components found: of each such node all pairs between different components are compared, so none is
lost. A node within one component has no such pair. Where at most ``CHUNK`` documents are outside a node's largest component, they meet all
others; other nodes branch on, and at the last depth they are compared whole, in cells of two chunks. Each document goes to a cell with its full set,
once for all its pairs there, and a cell sends no more links than connect its components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .components import components
from .groups import whole_groups

COORDINATES = 128
TREES = 12
FIRST_DEPTH, LAST_DEPTH = 2, 6
SMALL = 256            # documents of a node that is compared at once
CHUNK = 2048           # documents compared at once in nodes that stay large
PIVOTS, NEAREST = 4, 3
CROWD = 0.5            # share of a node that goes on together in a crowd
CENTRES = 8            # central documents of a crowd that all others are compared with
WORDS_CACHED = 400_000
CHUNK_SHINGLES = 2_000_000    # of the documents of a chunk that come with their full sets
BROADCAST_KEYS = 1_000_000


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, words lower-cased in A-Z; the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    span = min(width, len(ids))
    out = np.full(len(ids) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mixed(out + ids[k:len(ids) - span + 1 + k])
    return np.unique(out)


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    random = np.random.default_rng(20)
    factors = random.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(x.as_py(), width, hashes) for x in part.column("text")]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys, sketches = [None] * len(sets), [None] * len(sets)
            full = np.flatnonzero(sizes)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                least = np.empty((len(full), COORDINATES), np.uint16)
                for c in range(COORDINATES):
                    least[:, c] = _mixed(np.minimum.reduceat(every * factors[c] + shifts[c], starts)) >> np.uint64(48)
                for row, i in enumerate(full):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    sketches[i] = least[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "row_key", "n_shingles", "set_key", "sketch"])


def _member_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [shingles(x.as_py(), width, hashes) for x in batch.column("text").slice(at, 512)]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "members"])


def sketch_documents(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row_key, n_shingles, set_key, sketch), one per row; key and sketch are null for empty sets."""
    named = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return materialise(named.mapInArrow(
        lambda batches: _sketch_batches(batches, width),
        f"doc_id {kind}, row_key binary, n_shingles long, set_key binary, sketch binary"), "sketches")


def row_key(id_: Column, text: Column) -> Column:
    """128-bit digest of id and text; null ids and texts differ from all others."""
    told = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.octet_length(c.cast("string")), F.lit(":"), c.cast("string"))) for c in (id_, text)]
    return F.unhex(F.md5(F.concat(*told)))


def _branch(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (set_key, node) of the next depth, from rows (set_key, node, sketch)."""
    second = F.pmod(F.xxhash64(F.lit("second"), "node"), F.lit(1_000_000)) < F.lit(int((1 / threshold - 1) * 1_000_000))
    first, other = (F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(COORDINATES)).cast("int") for k in (1, 2))
    chosen = F.when(second, F.array(first, other)).otherwise(F.array(first))
    rows = rows.withColumn("coordinate", F.explode(chosen))
    return rows.withColumn("node", F.xxhash64("node", "coordinate", F.expr("substring(sketch, coordinate * 2 + 1, 2)")))


def _agreements(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal coordinates of each sketch on the left with each on the right."""
    same = np.zeros((len(left), len(right)), np.uint8)
    for x, y in zip(np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)):
        same += x[:, None] == y[None, :]
    return same


def _edges_within(sketches: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Candidate edges (i, j, score) of one node for the first round, its central documents, and whether other pairs are above ``least``.

    All pairs above ``least`` where they are few. In a crowd, where most pairs are, each document's nearest ones and its edges to
    central documents, which lie in the middle of the crowd and so are near to more documents than others; ``_apart`` finds the rest.
    """
    n = len(sketches)
    if n == 2:
        same = int((sketches[0] == sketches[1]).sum())
        hit = np.zeros(int(same >= least), np.int64)
        return hit, hit + 1, hit + same, np.array([0]), False
    same = _agreements(sketches, sketches)
    np.fill_diagonal(same, 0)
    near = same >= least
    central, weight = [], np.ones(n)
    for _ in range(min(PIVOTS, n)):
        gain = (same * near) @ weight
        if central:
            gain[central] = -1
        central.append(int(gain.argmax()))
        weight = weight * (1 - 0.7 * (same[central[-1]] / COORDINATES) ** 4 * near[central[-1]])
    i, j = np.nonzero(np.triu(near))
    part = len(i) > 8 * n
    if part:
        close = np.argpartition(-same.astype(np.int16), NEAREST, axis=1)[:, :NEAREST]
        i = np.concatenate([np.repeat(np.arange(n), NEAREST), np.tile(np.arange(n), len(central))])
        j = np.concatenate([close.ravel(), np.repeat(central, n)])
        hit = near[i, j]
        i, j = i[hit], j[hit]
    score = same[i, j].astype(np.int64) + 2 * COORDINATES * (np.isin(i, central[:1]) | np.isin(j, central[:1]))
    return i, j, score, np.array(central), part


def _compare_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(batches, ["node", "chunk"]):
        keys = np.array(table.column("set_key").to_pylist(), dtype=object)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        large = table.column("large").to_numpy(zero_copy_only=False)
        nodes = table.column("node").to_numpy()
        a, b, scores, pivots, of, centrality, parts = [], [], [], [], [], [], []
        for start, end in zip(bounds[:-1], bounds[1:]):
            if end - start < 2 and not large[start]:
                continue
            i, j, score, central, part = _edges_within(sketches[start:end], least) if end - start > 1 else (*[np.empty(0, int)] * 3, np.array([0]), False)
            a.append(keys[start + i])
            b.append(keys[start + j])
            scores.append(score)
            if large[start]:
                pivots.append(keys[start + central])
                own = sketches[start:end]
                centrality.append(np.array([int(1000 * (own == own[c]).mean()) for c in central]))
                of += [nodes[start]] * len(central)
            elif part:
                parts.append(nodes[start])
        left, right = (np.concatenate(x) if x else np.empty(0, object) for x in (a, b))
        swap = left > right
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        n = len(left)
        picked = np.concatenate(pivots) if pivots else np.empty(0, object)
        middle = np.concatenate(centrality) if centrality else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([*left, *picked, *[None] * len(parts)], pa.binary()), pa.array([*right, *[None] * (len(picked) + len(parts))], pa.binary()),
            pa.array(np.concatenate([*scores, middle, np.zeros(len(parts), np.int64)]).astype(np.int64), pa.int64()),
            pa.array([*[None] * n, *of, *parts], pa.int64())], ["a", "b", "score", "pivot_of"])


def _links(sets: list[np.ndarray], labels: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs out of (i, j), in the order of i, that are similar enough: enough of them to connect all labels that such pairs connect."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(len(numbers), bool)
    group = np.arange(int(labels.max()) + 1)
    out = []
    bounds = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for a, z in zip(bounds[:-1], bounds[1:]):
        x, others = i[a], j[a:z]
        others = others[group[labels[others]] != group[labels[x]]]
        own = numbers[starts[x]:starts[x + 1]]
        marked[own] = True
        for part in np.array_split(others, len(others) // 512 + 1):
            if len(part):
                ends = np.cumsum(sizes[part])
                at = np.arange(ends[-1]) + np.repeat(starts[part] - ends + sizes[part], sizes[part])
                both = np.add.reduceat(marked[numbers[at]].astype(np.int64), ends - sizes[part])
                for y in part[100 * both >= percent * (sizes[x] + sizes[part] - both)]:
                    if group[labels[y]] != group[labels[x]]:
                        group[group == group[labels[y]]] = group[labels[x]]
                        out.append((int(x), int(y)))
        marked[own] = False
    return out


def _cross_batches(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between documents with different labels, of cells (node, cell): between their sides, or within the only side."""
    for table, bounds in whole_groups(batches, ["node", "cell"]):
        keys, members = (table.column(c).combine_chunks() for c in ("set_key", "members"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        labels = table.column("label").combine_chunks().dictionary_encode()
        labels = (labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices.to_numpy()
        side, sizes = table.column("side").to_numpy(), table.column("n_shingles").to_numpy()
        for start, end in zip(bounds[:-1], bounds[1:]):
            left, right = (start + np.flatnonzero(side[start:end] == x) for x in (0, 1))
            if not len(left) or len(left) < 2 and not len(right):
                continue
            if within := not len(right):
                right = left
            x, y = sizes[left][:, None], sizes[right][None, :]
            hit = (labels[left][:, None] != labels[right][None, :]) & (100 * x >= percent * y) & (100 * y >= percent * x)
            if not hit.any():
                continue
            hit &= _agreements(sketches[left], sketches[right]) >= least
            i, j = np.nonzero(np.triu(hit) if within else hit)
            if len(i):
                used, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
                sets = [np.frombuffer(members[int(k)].as_py(), np.uint64) for k in used]
                told = np.unique(labels[used], return_inverse=True)[1]
                found = used[np.array(_links(sets, told, at[:len(i)], at[len(i):], percent), np.int64).reshape(-1, 2)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found[:, k])).cast(pa.binary()) for k in (0, 1)], ["a", "b"])


def _confirm_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("left"), batch.column("right")):
            x, y = (np.frombuffer(side.as_py(), np.uint64) for side in (left, right))
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _least(threshold: float) -> int:
    """Equal coordinates that a candidate pair has at least."""
    return int(COORDINATES * (threshold - 3.5 * (threshold * (1 - threshold) / COORDINATES) ** 0.5))


def _candidates(sets: DataFrame, percent: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b, score) of candidate edges between sets (set_key, sketch), a < b, and rows (set_key, node, depth) of the nodes with more pairs than these."""
    threshold = percent / 100
    least = _least(threshold)
    rows = sets.select("set_key", "sketch", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")).select(
        "set_key", "sketch", F.xxhash64(F.lit("root"), "tree").alias("node"))
    for _ in range(FIRST_DEPTH):
        rows = _branch(rows, threshold)
    rows = rows.select("set_key", "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("siblings"))
    sketches = sets.select("set_key", "sketch")
    small, crowds = [], []

    def as_crowd(large: DataFrame, depth: int) -> DataFrame:
        chunk = F.pmod(F.xxhash64("set_key", "node"), F.ceil(F.col("n") / CHUNK)).cast("int")
        return large.select("set_key", "node", chunk.alias("chunk"), F.lit(True).alias("large"), F.lit(depth).alias("depth"))

    large = None
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        # Written, as adaptive execution only splits a large node's rows in a join whose sides are both plain shuffles.
        sizes = materialise(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"), F.first("siblings").alias("siblings")).where(
            "n > 1"), "node-sizes")
        rows = rows.select("set_key", "node").join(sizes, "node")
        if large is not None:
            # A node most of whose documents go on together is a crowd: branching would only copy it.
            crowd = materialise(sizes.where(F.col("n") >= CROWD * F.col("siblings")).select(F.col("parent").alias("node")).distinct(), "crowds")
            crowds.append(as_crowd(large.join(crowd, "node", "left_semi"), depth - 1))
            rows = rows.join(crowd.withColumnRenamed("node", "parent"), "parent", "left_anti")
        rows = materialise(rows.select("set_key", "node", "n"), "paths")
        small.append(rows.where(F.col("n") <= SMALL).select("set_key", "node", F.lit(0).alias("chunk"), F.lit(False).alias("large"), F.lit(depth).alias("depth")))
        large = rows.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if depth == LAST_DEPTH:
            crowds.append(as_crowd(large, depth))
        else:
            rows = _branch(large.join(sketches, "set_key").withColumn("parent", F.col("node")), threshold).select(
                "set_key", "node", "parent", F.col("n").alias("siblings"))
    crowded = reduce(DataFrame.union, crowds) if crowds else None
    nodes = reduce(DataFrame.union, [*small, *crowds])
    compared = materialise(
        nodes.join(sketches, "set_key").repartition("node", "chunk").sortWithinPartitions("node", "chunk").select(
            "node", "chunk", "large", "set_key", "sketch").mapInArrow(
            lambda batches: _compare_batches(batches, least), "a binary, b binary, score long, pivot_of long"), "compared")
    edges = compared.where("b is not null").select("a", "b", "score")
    if crowded is not None:
        # All documents of a crowd meet its most central ones, whatever chunk these come from.
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "pivot"))
        pivots = compared.where("b is null and a is not null").select(F.col("pivot_of").alias("node"), F.col("a").alias("pivot"), "score").withColumn("rank", rank).where(
            F.col("rank") <= CENTRES).select("node", "pivot")
        edges = edges.union(crowded.select("node", "set_key").join(pivots, "node").where("set_key != pivot").select(
            F.least("set_key", "pivot").alias("a"), F.greatest("set_key", "pivot").alias("b"), F.lit(1).cast("long").alias("score")))
    edges = materialise(edges.groupBy("a", "b").agg(F.max("score").alias("score")), "candidates")
    parts = materialise(compared.where("a is null").select(F.col("pivot_of").alias("node")).distinct(), "part-nodes")
    again = reduce(DataFrame.union, small).select("set_key", "node", "depth").join(parts, "node", "left_semi").select("set_key", "node", "depth")
    if crowded is not None:
        again = again.union(crowded.select("set_key", "node", "depth"))
    return edges, materialise(again, "again")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (set_key, node, label, cell, side) of the blocks of a node that are compared, from rows (set_key, node, label, top, r, c).

    Documents with the node's most frequent label ``top`` have equal labels, so only the rest meets them and itself. Both are cut
    into blocks, ``c`` and ``r`` many, and each two blocks are a cell.
    """
    r, c = F.col("r"), F.col("c")
    own = lambda blocks: F.pmod(F.xxhash64("set_key", "node"), blocks)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda at, side: F.struct(at.alias("cell"), side.cast("int").alias("side"))
    among = F.transform(numbers(r), lambda k: cell(F.least(own(r), k) * r + F.greatest(own(r), k), own(r) > k))
    with_top = F.transform(numbers(c), lambda k: cell(r * r + own(r) * c + k, F.lit(0)))
    of_top = F.transform(numbers(r), lambda k: cell(r * r + k * c + own(c), F.lit(1)))
    every = F.when(F.col("label") == F.col("top"), of_top).otherwise(F.concat(among, with_top))
    return rows.select("set_key", "node", "label", F.explode(every).alias("at")).select("set_key", "node", "label", "at.cell", "at.side")


def _apart(again: DataFrame, sets: DataFrame, found: DataFrame, percent: int, members_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect different components of ``found`` within the nodes ``again``; all pairs above the sketch bound count.

    Nodes within one component are dropped, as no pair of theirs can join anything. ``members_of`` gives the full sets of rows (set_key).
    """
    marked = materialise(sets.select("set_key", "sketch", "n_shingles").join(found.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select(
        "set_key", "sketch", "n_shingles", F.coalesce("root", "set_key").alias("label")), "marked")
    rows, cells = again.join(marked.select("set_key", "n_shingles", "label"), "set_key"), []
    blocks = lambda n, size: F.ceil(F.greatest(F.expr(n) / CHUNK, F.expr(size) / CHUNK_SHINGLES)).cast("long")
    while True:
        labelled = materialise(rows, "labelled")
        nodes = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).groupBy("node").agg(
            F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most")).where("n > most.n")
        nodes = materialise(nodes.select("node", F.col("most.label").alias("top"), F.expr("n - most.n").alias("rest"),
                                         blocks("n - most.n", "size - most.size").alias("r"), blocks("most.n", "most.size").alias("c")), "mixed")
        mixed = materialise(labelled.join(nodes, "node"), "mixed-paths")
        on = (F.col("rest") > CHUNK) & (F.col("depth") < LAST_DEPTH)
        cells.append(materialise(_cells(mixed.where(~on)), "cells"))
        if mixed.where(on).isEmpty():
            break
        rows = _branch(mixed.where(on).join(marked.select("set_key", "sketch"), "set_key"), percent / 100).select(
            "set_key", "node", (F.col("depth") + 1).alias("depth"), "n_shingles", "label")
    cells = reduce(DataFrame.union, cells)
    whole = marked.select("set_key", "sketch", "n_shingles").join(members_of(cells.select("set_key").distinct()), "set_key")
    return materialise(cells.join(whole, "set_key").repartition("node", "cell").sortWithinPartitions("node", "cell").select(
        "node", "cell", "side", "set_key", "label", "sketch", "n_shingles", "members").mapInArrow(
            lambda batches: _cross_batches(batches, _least(percent / 100), percent), "a binary, b binary"), "apart")


def _members(docs: DataFrame, keys: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (set_key, members) of the documents with the row keys ``keys``, one per set; only these are read out again."""
    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    found = texts.join(keys, "row_key", "left_semi").select("text").mapInArrow(
        lambda batches: _member_batches(batches, width), "set_key binary, members binary")
    return materialise(found.dropDuplicates(["set_key"]), "members")


def _confirmed(edges: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    pairs = edges.select("a", "b").join(members.select(F.col("set_key").alias("a"), F.col("members").alias("left")), "a").join(
        members.select(F.col("set_key").alias("b"), F.col("members").alias("right")), "b")
    return materialise(pairs.select("a", "b", "left", "right").mapInArrow(
        lambda batches: _confirm_batches(batches, percent), "a binary, b binary"), "links")


def near_components(docs: DataFrame, width: int = 3, percent: int = 85, trees: int = TREES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row_key, n_shingles, root, component_id), one per row of ``docs``.

    ``root`` identifies a component and is null for empty sets. ``row_key`` is a hash of id and text.
    """
    rows = sketch_documents(docs, width, id_col, text_col)
    sets = materialise(rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "sets")
    edges, again = _candidates(sets, percent, trees)
    ends = edges.select(F.explode(F.array("a", "b")).alias("end"), F.struct("score", "a", "b").alias("edge"))
    keys = materialise(ends.select(F.col("end").alias("set_key")).distinct().join(sets.select("set_key", "row_key"), "set_key").select("set_key", "row_key"), "keys")
    members = _members(docs, keys.select("row_key"), width, id_col, text_col)
    best = materialise(ends.groupBy("end").agg(F.max("edge").alias("edge")).select("edge.a", "edge.b").distinct(), "best-edges")
    links = _confirmed(best, members, percent)
    found = components(links)
    left, right = (found.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    apart = edges.join(best, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = _confirmed(apart, members, percent)
    found = components(links.union(more))
    if not again.isEmpty():
        def members_of(wanted: DataFrame) -> DataFrame:
            others = wanted.join(keys, "set_key", "left_anti").join(sets.select("set_key", "row_key"), "set_key").select("row_key")
            late = _members(docs, materialise(others, "keys"), width, id_col, text_col)
            return members.union(late).join(wanted, "set_key", "left_semi")

        late = _apart(again, sets, found, percent, members_of)
        if not late.isEmpty():
            found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(late))
    found = found.select(F.col("node").alias("set_key"), "root")
    roots = sets.select("set_key", "first_id").join(found, "set_key", "left").select(
        "set_key", "first_id", F.coalesce("root", "set_key").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialise(roots.join(ids, "root").select("set_key", "root", "component_id"), "labels")
    return rows.select("doc_id", "row_key", "n_shingles", "set_key").join(labels, "set_key", "left").select(
        "doc_id", "row_key", "n_shingles", "root", F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("doc_id"))).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``.

    Documents whose sets of ``width``-word shingles share ``percent`` of their union at least are linked; a component is what links
    reach, and has the smallest id in it. A document with fewer words is one shingle; null, empty and blank texts have no shingle, are linked with
    nothing and are kept. Rows without an id are kept only if their component has no id. Repeated rows share all results. Other columns are
    ignored, and an empty table gives no rows.
    """
    found = near_components(docs, width, percent, id_col=id_col, text_col=text_col)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, that with the smallest id; texts without words all stay. Rows equal in id and text count once."""
    found = near_components(docs, width, percent, id_col=id_col, text_col=text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    own = F.when(F.col("root").isNull(), F.col("row_key"))
    stay = found.groupBy("root", own.alias("own")).agg(F.min(order).alias("least")).select(F.col("least.row_key").alias("row_key"))
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return rows.join(stay, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
