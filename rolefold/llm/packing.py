"""Packing of tokenised documents into sequences by patterns of lengths.

Patterns of up to three lengths that fill a sequence exactly, or almost, are enumerated; repeat counts are fitted to the histogram of lengths by
non-negative least squares, rounded, and cut to what is there. What they leave is packed by best fit, on the histogram as well. The driver sees one count per
length and gives back one row per slot of a pattern, so its work does not depend on the number of documents; pieces find their slots by their rank among
pieces of their length, which comes from counts per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .byte_bpe import ByteBpe

CLASSES = 1024      # length classes; a longer sequence has wider ones
FIT = 1e-3          # part of all pieces that the fit may leave
ROUNDS = 100        # of the fit, each of which adds patterns
SLOWEST = 0.9995    # error of a round against the round before at which the fit ends
ADDED = 128         # patterns a round
NEAR = 4            # free classes that a pair may leave, for lengths whose exact partners have run out
AT_ONCE = 256       # texts


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, with a shorter first piece for the rest."""
    whole, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * whole


def patterns_of(classes: int, present: np.ndarray) -> np.ndarray:
    """All pairs and triples of present classes that sum to ``classes``, and pairs up to ``NEAR`` short of it; a pair has class 0 as its third."""
    first, second = np.triu_indices(classes)
    third = classes - first - second
    good = (third >= second) | (third == 0)
    found = np.stack([first, second, third], 1)[good & (first + second > 0)]
    found = np.where(found[:, :1] > 0, found, np.roll(found, -1, 1))
    found = np.unique(np.sort(found, 1)[:, ::-1], axis=0)
    near = np.array([(a, total - a, 0) for total in range(max(2, classes - NEAR), classes) for a in range((total + 1) // 2, total)], int)
    found = np.concatenate([found, near.reshape(-1, 3)])
    has = present.copy()
    has[0] = True
    found = found[has[found].all(1) & (found[:, 0] < classes)]
    return found


def fitted_counts(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts, none negative, whose pieces come nearest to ``counts`` by squares.

    An active set: the patterns with the steepest descent join, normal equations are solved, and patterns that come out negative leave.
    """
    out, total = np.zeros(len(patterns)), counts.sum()
    if not len(patterns):
        return out
    # Squares are weighed by the counts, so that a length which many documents share does not outweigh all others.
    weight = np.where(counts > 0, 1 / np.maximum(counts, 1), 0.0)
    weight[0] = 0
    uses = (patterns[:, :, None] == patterns[:, None, :]).sum(1)
    norm = np.sqrt((weight[patterns] * uses).sum(1))
    left, error, active, amounts = counts.astype(float), np.inf, np.zeros(0, int), np.zeros(0)
    for _ in range(ROUNDS):
        slope = (weight * left)[patterns].sum(1) / norm
        slope[active] = 0
        steep = np.argsort(-slope, kind="stable")[:ADDED * 8]
        taken, joining = set(), []
        for k in steep[slope[steep] > 1e-9].tolist():
            own = set(patterns[k].tolist()) - {0}
            if not own & taken and len(joining) < ADDED:
                taken |= own
                joining.append(k)
        if not joining:
            break
        active = np.concatenate([active, joining]).astype(int)
        while True:
            matrix = np.zeros((len(counts), len(active)))
            for column in range(3):
                np.add.at(matrix, (patterns[active, column], np.arange(len(active))), 1.0)
            matrix[0] = 0
            heavy = matrix.T * weight
            square = heavy @ matrix
            square[np.diag_indices(len(active))] += 1e-9 * square.diagonal().max()
            amounts = np.linalg.solve(square, heavy @ counts)
            if (amounts > 0).all():
                break
            active = active[amounts > 0]
        left = counts - matrix @ amounts
        left[0] = 0
        last, error = error, np.abs(left).sum()
        if error <= FIT * total or error > SLOWEST * last:
            break
    out[active] = amounts
    return out


def best_fit(counts: np.ndarray, classes: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: (content, number of sequences), a content being (class, copies) pairs.

    Equal pieces go into equal sequences together, so the work depends on the number of classes alone.
    """
    open_: dict[int, list[list]] = {}         # free classes → [content, number]
    closed = []

    def put(content, number, free):
        if number:
            (open_.setdefault(free, []) if free else closed).append([content, number])

    for c in range(classes, 0, -1):
        n = int(counts[c])
        for free in sorted(f for f in open_ if f >= c):
            if not n:
                break
            copies = free // c
            for content, number in open_.pop(free):
                full = min(number, n // copies)
                put(content + ((c, copies),), full, free - copies * c)
                n, number = n - full * copies, number - full
                if number and n and n < copies:
                    put(content + ((c, n),), 1, free - n * c)
                    n, number = 0, number - 1
                put(content, number, free)
        copies = classes // c
        put(((c, copies),), n // copies, classes - copies * c)
        if n % copies:
            put(((c, n % copies),), 1, classes - n % copies * c)
    return [(content, number) for content, number in closed + [x for group in open_.values() for x in group]]


def packing_plan(counts: np.ndarray, classes: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(content, number of sequences) that hold exactly ``counts`` pieces of each class."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan = [(((classes, 1),), int(left[classes]))] if left[classes] else []
    left[classes] = 0
    patterns = patterns_of(classes, left > 0)
    amounts = np.floor(fitted_counts(patterns, left) + 0.5).astype(np.int64)
    for k in sorted(np.flatnonzero(amounts).tolist(), key=lambda k: (-amounts[k], k)):
        own, uses = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        number = min(int(amounts[k]), int((left[own] // uses).min()))
        if number > 0:
            left[own] -= uses * number
            plan.append((tuple((int(c), int(u)) for c, u in zip(own[::-1], uses[::-1])), number))
    return plan + best_fit(left, classes)


def _slot_rows(plan) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first, last, copies, sequence, slot): ranks ``first`` … ``last`` of a class go into sequences from ``sequence`` on, ``copies`` into each."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for content, number in plan:
        for slot, (c, copies) in enumerate(content):
            first = taken.get(c, 0)
            taken[c] = first + number * copies
            rows.append((c, first, taken[c] - 1, copies, sequence, slot))
        sequence += number
    return rows


def _piece_batches(batches: Iterator[pa.RecordBatch], spec, capacity: int, width: int, end: int, keep: bool) -> Iterator[pa.RecordBatch]:
    bpe, seen, task = None, {}, TaskContext.get().partitionId()
    for batch in batches:
        bpe = bpe or ByteBpe(spec.value, special=True)
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            source, columns = [], [[] for _ in range(8)]
            for row, text in enumerate(part.column("text").to_pylist()):
                ids = np.array(bpe.encode(text or "") + [end], "<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                    own, size = ids[start:start + length].tobytes(), -(-length // width)
                    nth = seen.get(size, 0)
                    seen[size] = nth + 1
                    source.append(row)
                    for column, value in zip(columns, (piece, start, length, zlib.crc32(own), size, task, nth, own if keep else None)):
                        column.append(value)
                    start += length
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(source, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "size", "task", "nth", "ids"])


def pack_documents(
    docs: DataFrame, spec: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and its ``ids`` if they are to be kept.

    A document's ids are those of its text, special tokens included, and ``end``. Documents of more than ``capacity`` ids are cut into pieces of
    ``capacity``, of which the first may be shorter; others stay whole. Null texts are empty ones and one id long. Rows with equal or null ids are
    documents of their own; texts of any length are read whole; an empty table gives no rows; other columns are ignored. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(spec)
    width = -(-capacity // CLASSES)
    classes = capacity // width
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    # A task's numbers are fixed once its rows are written.
    pieces = materialise(named.mapInArrow(
        lambda batches: _piece_batches(batches, sent, classes * width, width, end, keep_ids),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, size int, task int, nth long, ids binary"), "pieces")
    by_task = materialise(pieces.groupBy("size", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(classes + 1, np.int64)
    for row in by_task.groupBy("size").agg(F.sum("n").alias("n")).collect():
        counts[row["size"]] = row["n"]
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("size", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slots = spark.createDataFrame(_slot_rows(packing_plan(counts, classes)),
                                  "size int, first long, last long, copies long, sequence long, slot int")
    ranked = pieces.join(firsts, ["size", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    # A few rows per class, whatever the number of documents.
    placed = ranked.join(F.broadcast(slots), "size").where(F.col("rank").between(F.col("first"), F.col("last"))).withColumns({
        "sequence_id": F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("copies")),
        "copy": (F.col("rank") - F.col("first")) % F.col("copies")})
    inside = Window.partitionBy("sequence_id").orderBy("slot", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), *(["ids"] if keep_ids else []))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): the ids of each sequence, and (doc_id, piece, offset, length) of what it holds, from pieces with their ids."""
    listed = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "piece", "doc_id", "length", "ids"))).alias("held"))
    return listed.select(
        "sequence_id", F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("held", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"))
