"""Removal of repeated byte strings with a run-length index.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier. Two equal strings hold the same anchor: the leftmost of their
32-byte grams with the least hash. So strings are compared only around equal anchors, in three steps:

1. In a task, and then among tasks, occurrences of an anchor with the same context (all bytes that a string with that anchor can
   have) are one class. Of each class only the first occurrence keeps its strings; the others are removed at once. Each task sends one
   row per class and million classes at most, so a passage in a third of all documents is a row or a few per task.
2. The first occurrences of classes that share an anchor differ somewhere. Their contexts, a small and very repetitive part of the corpus, get a
   run-length index: the Burrows-Wheeler transform as runs, each with the earliest place of the strings at its rows as sample. Streaming each
   context through it from its end, one step per byte, gives for each of its strings whether an earlier one is equal.
3. An anchor with more classes than a task should hold has its strings compared by their hashes instead, which splits as finely as one likes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .groups import group_bounds, whole_groups

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM              # bytes of a string before or after its anchor at most
PIECE = 1 << 20                    # bytes of text hashed at once
FRESH, KEPT = 1 << 19, 1 << 20     # anchors compared at once at least, and first occurrences that a task holds before it sends them
INDEX_BYTES = 256 << 10            # context bytes of one index; an anchor's contexts stay together
HOT_CLASSES = 20_000               # classes of an anchor that are indexed; more are compared by hash
_BASE = 0x9E3779B97F4A7C15
_HASH_BITS = np.uint64(0xFFFFFF0000000000)


class _Powers:
    """Powers of the base and of its inverse, as far as needed."""

    def __init__(self, n: int):
        self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)]))


_LETTERS = np.random.default_rng(9).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    return _mixed((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, low: np.ndarray, high: np.ndarray, strings: np.ndarray, powers: _Powers) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, place, bytes before and after it of each anchor of the strings that start at ``strings``.

    ``low`` and ``high`` are each byte's document borders within ``data``.
    """
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * powers.up[:len(data)], dtype=np.uint64)])
    n = len(data) - GRAM + 1
    at = np.arange(n)
    grams = _hashes(sums, at, at + GRAM, powers)
    least = (grams & _HASH_BITS) | at.astype(np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[:-(REACH + 1 - 64)], least[REACH + 1 - 64:])
    place = np.unique((least[strings] & ~_HASH_BITS).astype(np.int64))
    left = np.maximum(low[place], place - REACH)
    right = np.minimum(high[place], place + LENGTH)
    context = _hashes(sums, left, right, powers) + _mixed((place - left).astype(np.uint64))
    return grams[place].view(np.int64), context.view(np.int64), place, place - left, right - place


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Data, document borders, string starts, document and offset of each byte: short texts together, long ones in overlapping parts."""
    margin = 2 * LENGTH
    batch: list[tuple[int, int, int, int]] = []

    def built():
        sizes = np.array([z - a for _, a, z, _ in batch])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts[d][a:z] for d, a, z, _ in batch), np.uint8)
        part = np.repeat(np.arange(len(batch)), sizes)
        offset = np.arange(len(data)) - edges[part] + np.array([a for _, a, _, _ in batch])[part]
        until = np.array([len(texts[d]) for d, _, _, _ in batch])[part]
        own = np.array([s for _, _, _, s in batch])[part]
        strings = np.flatnonzero((offset >= own) & (offset + LENGTH <= until) & (offset < own + PIECE))
        return data, edges[part], edges[part + 1], strings, np.array([d for d, _, _, _ in batch])[part], offset

    size = 0
    for d, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for start in range(0, len(text), PIECE):
            a, z = max(0, start - margin), min(len(text), start + PIECE + margin)
            batch.append((d, a, z, start))
            size += z - a
            if size >= PIECE:
                yield built()
                batch, size = [], 0
    if batch:
        yield built()


def _merged(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each owner joined where they touch."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    shift = owner.astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return start[first], (np.append(reach[first[1:] - 1], reach[-1]) - shift[first]), owner[first]


class _Classes:
    """First occurrences of the classes met so far in a task, and the bytes of later ones.

    Holds ``KEPT`` first occurrences and as many rows not yet compared at most, whatever the size of the task's partition; a class met
    again after they were sent has another row.
    """

    def __init__(self, kind):
        self.kind, self.ids, self.keys, self.fresh, self.n_fresh = kind, [], [], [], 0
        self.firsts = (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.int32), np.empty(0, np.int32))

    def add(self, ids: list, keys: list, anchor: np.ndarray, context: np.ndarray, owner: np.ndarray, *places: np.ndarray) -> None:
        """Anchors of documents; ``owner`` counts within ``ids``."""
        self.fresh.append((anchor, context, owner + len(self.ids), *places))
        self.n_fresh += len(anchor)
        self.ids += ids
        self.keys += keys

    def full(self) -> bool:
        return self.n_fresh >= max(FRESH, len(self.firsts[0]))

    def _rows(self, anchor, context, owner, at, before, after) -> Iterator[pa.RecordBatch]:
        doc_ids, text_keys = pa.array(self.ids, self.kind), pa.array(self.keys, pa.int64())
        for k in np.array_split(np.arange(len(owner)), len(owner) // 50_000 + 1):
            who = pa.array(owner[k])
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[k]), pa.array(context[k]), doc_ids.take(who), text_keys.take(who), *(pa.array(x[k], pa.int32()) for x in (at, before, after))],
                ["anchor", "context", "doc_id", "text_key", "at", "before", "after"])

    def compared(self) -> Iterator[pa.RecordBatch]:
        """Rows of bytes to remove; each class has one occurrence left after this."""
        anchor, context, owner, at, left, right = (np.concatenate(x) for x in zip(self.firsts, *self.fresh))
        self.fresh, self.n_fresh = [], 0
        if not len(anchor):
            return
        rank = _ranks(self.ids, self.keys)
        order = np.lexsort((at, rank[owner], context, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1])])
        head = order[new][np.cumsum(new) - 1]                 # first occurrence of each row's class
        gone = order[(rank[owner[order]] != rank[owner[head]]) | (at[order] != at[head])]
        start, end, of = _merged(at[gone] - left[gone], at[gone] + right[gone], owner[gone])
        # Removed bytes travel along, spread by a hash; -1 marks them.
        spread = _mixed(of.astype(np.uint64) + _mixed(start.astype(np.uint64))).view(np.int64)
        yield from self._rows(spread, np.zeros(len(of), np.int64), of, start, np.full(len(of), -1), end - start)
        f = order[new]
        used, place = np.unique(owner[f], return_inverse=True)
        self.firsts = (anchor[f], context[f], place, at[f], left[f], right[f])
        self.ids, self.keys = [self.ids[d] for d in used], [self.keys[d] for d in used]

    def sent(self) -> Iterator[pa.RecordBatch]:
        yield from self._rows(*self.firsts)
        self.__init__(self.kind)


def _anchor_batches(batches: Iterator[pa.RecordBatch], kind) -> Iterator[pa.RecordBatch]:
    """Rows of first occurrences in the task (``before`` not negative) and of bytes to remove (-1)."""
    powers = _Powers(2 * PIECE + 4 * LENGTH)
    classes = _Classes(kind)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column("text")]
            ids, keys = part.column("doc_id"), part.column("text_key")
            for data, low, high, strings, owner, offset in _pieces(texts):
                anchor, context, place, left, right = anchors(data, low, high, strings, powers)
                docs, of = np.unique(owner[place], return_inverse=True)
                classes.add(ids.take(pa.array(docs)).to_pylist(), keys.take(pa.array(docs)).to_pylist(), anchor, context, of, offset[place],
                            left.astype(np.int32), right.astype(np.int32))
                if classes.full():
                    yield from classes.compared()
                    if len(classes.firsts[0]) >= KEPT:
                        yield from classes.sent()
    yield from classes.compared()
    yield from classes.sent()


def _ranks(ids: list, keys: list) -> np.ndarray:
    """Places of documents in the order of ids, null last, then of text keys; equal ones share a place."""
    order = sorted(range(len(ids)), key=lambda d: (ids[d] is None, 0 if ids[d] is None else ids[d], keys[d]))
    new = np.array([True, *((ids[a], keys[a]) != (ids[b], keys[b]) for a, b in zip(order, order[1:]))])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _resolve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, context and place: bytes to remove (anchor null), and contexts to compare (anchor given).

    A class has a row or a few per task, so a class is a small group; an anchor's classes pass by one after the other.
    """
    cuts: list[pa.RecordBatch] = []

    def classes():
        for batch in batches:
            marked = batch.column("before").to_numpy() < 0
            cuts.append(batch.filter(pa.array(marked)))
            yield batch.filter(pa.array(~marked))

    def spans(rows, anchored: bool):
        at, before, after = (rows.column(c).to_numpy() for c in ("at", "before", "after"))
        return pa.RecordBatch.from_arrays([
            rows.column("anchor") if anchored else pa.nulls(rows.num_rows, pa.int64()), rows.column("doc_id"), rows.column("text_key"),
            pa.array(at - np.maximum(before, 0), pa.int32()), pa.array(at + after, pa.int32())], ["anchor", "doc_id", "text_key", "start", "end"])

    def removed():
        while cuts:
            part = cuts.pop()
            if part.num_rows:
                yield spans(part, False)

    waiting = None           # head of the last class, while it is not known whether its anchor has another class
    last = None
    for table, bounds in whole_groups(classes(), ["anchor", "context"]):
        rows = table.to_batches()[0]
        heads = bounds[:-1]
        anchor = rows.column("anchor").to_numpy()[heads]
        with_next = np.append(anchor[1:] == anchor[:-1], False)
        with_last = np.concatenate([[last is not None and anchor[0] == last], anchor[1:] == anchor[:-1]])
        if waiting is not None and waiting.column("anchor")[0].as_py() == anchor[0]:
            yield spans(waiting, True)
        waiting = None if with_last[-1] else rows.slice(int(heads[-1]), 1)
        last = anchor[-1]
        compare = heads[with_next | with_last]
        if len(compare):
            yield spans(rows.take(pa.array(compare)), True)
        head = np.repeat(heads, np.diff(bounds))
        ids, keys, at = rows.column("doc_id"), rows.column("text_key").to_numpy(), rows.column("at").to_numpy()
        others = np.flatnonzero(np.arange(len(head)) != head)
        if len(others):
            own, first = ids.take(pa.array(others)).to_pylist(), ids.take(pa.array(head[others])).to_pylist()
            real = np.array([x != y for x, y in zip(own, first)]) | (keys[others] != keys[head[others]]) | (at[others] != at[head[others]])
            if real.any():
                yield spans(rows.take(pa.array(others[real])), False)
        yield from removed()
    yield from removed()


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            anchor, rows, starts, data = [], [], [], []
            part = batch.slice(at, 256)
            for row, (text, wanted) in enumerate(zip(part.column("text"), part.column("wanted"))):
                spans = wanted.as_py()
                if spans:
                    whole = text.as_py().encode("utf-8", "surrogatepass")
                    for span in spans:
                        anchor.append(span["anchor"])
                        rows.append(row)
                        starts.append(span["start"])
                        data.append(whole[span["start"]:span["end"]])
            who = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor, pa.int64()), part.column("doc_id").take(who), part.column("text_key").take(who), pa.array(starts, pa.int32()),
                pa.array(data, pa.binary())], ["anchor", "doc_id", "text_key", "start", "context"])


def suffix_order(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffix array, its inverse, and ranks by the first ``depth`` symbols with the greatest depth up to ``LENGTH`` that was passed.

    Every text ends with a symbol of its own, so all suffixes differ. Ranks by twice as many symbols come from pairs of ranks.
    """
    n = len(symbols)
    depth = 62 // bits
    padded = np.concatenate([symbols, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = (key << bits) | padded[k:n + k]
    partial, passed = None, 0
    while True:
        order = np.argsort(key)          # equal keys get one rank, so their order does not matter
        ordered = key[order]
        dense = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if depth <= LENGTH:
            partial, passed = rank, depth
        if dense[-1] == n - 1:
            return order, rank, partial, passed
        key = rank * (n + 1)
        key[:n - depth] += rank[depth:] + 1
        depth *= 2


class RunIndex:
    """Runs of the Burrows-Wheeler transform of some texts, cut where strings of ``LENGTH`` bytes change, with the earliest place of each."""

    def __init__(self, texts: list[bytes], places: np.ndarray):
        m = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, m)
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + m
        symbols[ends] = np.arange(m)
        place = np.repeat(places - (ends - sizes), sizes + 1) + np.arange(len(symbols))
        order, rank, partial, depth = suffix_order(symbols, int(m + 256).bit_length())
        padded = np.concatenate([partial, np.full(LENGTH, -1, np.int64)])
        new = np.zeros(len(order), bool)
        new[0] = True
        for offset in [*range(0, LENGTH - depth, depth), LENGTH - depth]:
            ranks = padded[order + offset]
            new[1:] |= ranks[1:] != ranks[:-1]
        strings = np.flatnonzero(new)
        earliest = np.minimum.reduceat(place[order], strings)[np.cumsum(new) - 1]
        step = rank[order - 1]                    # row of the suffix one byte longer
        run = new
        run[1:] |= step[1:] != step[:-1] + 1
        self.starts = np.flatnonzero(run)
        self.steps, self.earliest = step[self.starts], earliest[self.starts]

    def __len__(self) -> int:
        return len(self.starts)

    def find(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, rows, "right") - 1


def repeated_ranges(texts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start in each text of a string that also has an earlier place; -1 where there is none.

    ``places`` orders the texts' first bytes. All texts are streamed through their index together, from the end, a byte a step. The row of a
    text's end is its number, as ends are the smallest symbols.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    index = RunIndex(texts, places)
    first, last = np.full(len(texts), -1), np.full(len(texts), -1)
    active = np.argsort(-sizes, kind="stable")
    rows, runs = active.copy(), index.find(active)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        n = int(np.searchsorted(-sizes[active], -step, "right"))
        active, rows, runs = active[:n], rows[:n], runs[:n]
        rows = index.steps[runs] + rows - index.starts[runs]
        runs = index.find(rows)
        offset = sizes[active] - step
        hit = index.earliest[runs] < places[active] + offset
        first[active[hit]] = offset[hit]
        fresh = hit & (last[active] < 0)
        last[active[fresh]] = offset[fresh]
    return first, last


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(batches, ["anchor"]):
        rows = table.to_batches()[0]
        texts = rows.column("context").to_pylist()
        size = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        group = 0
        while group < len(bounds) - 1:
            until = max(int(np.searchsorted(size[bounds], size[bounds[group]] + INDEX_BYTES, "right")) - 1, group + 1)
            a, z = bounds[group], bounds[until]
            part = rows.slice(a, z - a)
            rank = _ranks(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist())
            start = part.column("start").to_numpy().astype(np.int64)
            first, last = repeated_ranges(texts[a:z], (rank << 32) + start)
            hit = np.flatnonzero(first >= 0)
            who = pa.array(hit)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(who), part.column("text_key").take(who), pa.array(start[hit] + first[hit], pa.int32()),
                pa.array(start[hit] + last[hit] + LENGTH, pa.int32())], ["doc_id", "text_key", "start", "end"])
            group = until


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all strings of contexts."""
    powers = _Powers(4 * LENGTH)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            found, rows, places = [], [], []
            for row, context in enumerate(part.column("context")):
                data = np.frombuffer(context.as_py(), np.uint8)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * powers.up[:len(data)], dtype=np.uint64)])
                k = np.arange(len(data) - LENGTH + 1)
                found.append(_hashes(sums, k, k + LENGTH, powers))
                rows.append(np.full(len(k), row))
                places.append(k)
            who = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            offset = np.concatenate(places) if places else np.empty(0, np.int64)
            start = part.column("start").to_numpy()[who.to_numpy()] + offset
            yield pa.RecordBatch.from_arrays([
                part.column("anchor").take(who), pa.array((np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64)),
                part.column("doc_id").take(who), part.column("text_key").take(who), pa.array(start, pa.int32())],
                ["anchor", "string", "doc_id", "text_key", "start"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [[], [], [], []]
            for text, gone in zip(part.column("text"), part.column("gone")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at_, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for span in sorted((x["start"], x["end"]) for x in gone.as_py() or []):
                    if span[0] > end:
                        kept.update(data[at_:span[0]])
                        spans += 1
                        removed += span[1] - span[0]
                        at_ = end = span[1]
                    elif span[1] > end:
                        removed += span[1] - end
                        at_ = end = span[1]
                kept.update(data[at_:])
                for column, value in zip(columns, (len(data), removed, spans, kept.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _joined(docs: DataFrame, spans: DataFrame, name: str, *fields: str) -> DataFrame:
    """``docs`` with the list ``name`` of their spans."""
    lists = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.collect_list(F.struct(*fields)).alias(name))
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["of_id"]) & (docs["text_key"] == lists["of_key"]), "left").select("doc_id", "text_key", "text", name)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one per row of ``docs``.

    Texts are taken as UTF-8, null ones as empty. Documents without an id come after all others; documents with one id come in the order of a
    hash of their texts; rows equal in id and text are one document and have the same result. Other columns are ignored, and an empty table
    gives no rows. Strings count as equal if two 64-bit hashes of them or of their surroundings are; within an index bytes are compared.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    order = [F.col("doc_id").isNull(), "doc_id", "text_key"]
    span = f"doc_id {kind}, text_key long, start int, end int"
    found = named.mapInArrow(
        lambda batches: _anchor_batches(batches, arrow), f"anchor long, context long, doc_id {kind}, text_key long, at int, before int, after int")
    spans = materialise(found.repartition("anchor").sortWithinPartitions("anchor", "context", *order, "at").mapInArrow(
        _resolve_batches, f"anchor long, {span}"), "byte-spans")
    removed, compare = spans.where("anchor is null").drop("anchor"), spans.where("anchor is not null")
    hot = materialise(compare.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_CLASSES).select("anchor"), "hot-anchors")
    contexts = _joined(named, compare, "wanted", "anchor", "start", "end").select("doc_id", "text_key", "text", "wanted").mapInArrow(
        _context_batches, f"anchor long, doc_id {kind}, text_key long, start int, context binary")
    if not hot.isEmpty():
        strings = contexts.join(hot, "anchor", "left_semi").mapInArrow(
            _string_batches, f"anchor long, string long, doc_id {kind}, text_key long, start int")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "start")
        first = strings.groupBy("anchor", "string").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select(
            "anchor", "string", "first")
        again = strings.join(first, ["anchor", "string"]).where(place != F.col("first"))
        removed = removed.union(again.select("doc_id", "text_key", "start", (F.col("start") + LENGTH).alias("end")))
        contexts = contexts.join(hot, "anchor", "left_anti")
    indexed = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index_batches, span)
    return _joined(named, removed.union(indexed), "gone", "start", "end").mapInArrow(
        _cut_batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
