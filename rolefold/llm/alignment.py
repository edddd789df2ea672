"""Alignment of two tokenisations of each text by lockstep merging.

Both tokenisers cover the same bytes. All documents of a chunk are merged at once: one NumPy state vector holds a pointer into A's and one into B's token
ends for every lane, each step emits a link per lane, marks a cut where both ends are equal, moves the pointers, and leaves out finished lanes. A lane is a document, or
a stretch of a long one between two ends that both have, so that one long text does not leave the vector with a single entry.

The number of documents in which a pair of ids is linked is a count over the corpus. A task sends each pair once per chunk of some megabytes of
text, and gets its count back, once per chunk as well; the links themselves stay with their chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .byte_bpe import ByteBpe, token_bytes

CHUNK_BYTES = 2 << 20    # of text; a longer text is a chunk of its own
LANE = 256               # A tokens after which a lane may end
PROBES = 64              # tokens among which a common end is looked for there
BITS = 32                # of a B id in a pair's key


class Tokenisers:
    """Ids and token bytes of a byte-level BPE file (A) and of a piece model (B)."""

    def __init__(self, spec: str, model: bytes):
        self.a = ByteBpe(spec, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        entries = token_bytes(spec)
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.wide = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(self.wide)]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none where one of them does not give back a blank and the text."""
        none = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if not text:
            return none
        data = b" " + text.encode()
        a, b = self.a.encode(" " + text), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return none
        return np.array(a, np.int32), np.array(b, np.int32)


def _lane_starts(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray) -> np.ndarray:
    """A positions after common ends, about ``LANE`` apart, besides the documents' own starts."""
    many = np.maximum((a_to - a_from - 1) // LANE, 0)
    if not many.sum():
        return np.zeros(0, np.int64)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    at = np.repeat(a_from, many) + step * LANE
    probes = at[:, None] + np.arange(min(PROBES, LANE))
    inside = probes < np.repeat(a_to, many)[:, None] - 1
    ends = a_ends[np.minimum(probes, len(a_ends) - 1)]
    common = inside & (b_ends[np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)] == ends)
    return (probes[np.arange(len(at)), common.argmax(1)] + 1)[common.any(1)]


def merge_lockstep(
    a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as A and B positions, and whether a cut follows each A and each B token.

    Ends are byte offsets over all documents, one after the other; ``a_from`` and ``a_to`` are the documents' A positions, none of them empty.
    """
    starts = np.unique(np.concatenate([a_from, _lane_starts(a_ends, b_ends, a_from, a_to)]))
    stops = np.append(starts[1:], len(a_ends))
    i, j = starts, np.searchsorted(b_ends, np.where(starts > 0, a_ends[starts - 1], -1), "right")
    a_links, b_links = [], []
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    while len(i):
        a_links.append(i)
        b_links.append(j)
        a, b = a_ends[i], b_ends[j]
        same = a == b
        a_cut[i[same]] = True
        b_cut[j[same]] = True
        i, j = i + (a <= b), j + (b <= a)
        going = i < stops
        if not going.all():
            i, j, stops = i[going], j[going], stops[going]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a_links or none), np.concatenate(b_links or none), a_cut, b_cut


class Chunk:
    """The alignment of some documents."""

    def __init__(self, tokenisers: Tokenisers, texts: list[str | None]):
        ids = [tokenisers.ids(t) for t in texts]
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([x[k] for x in ids] or [np.zeros(0, np.int32)]) for k in (0, 1))
        a_to, b_to = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.a_from, self.b_from = a_to - self.n_a, b_to - self.n_b
        a_ends, b_ends = np.cumsum(tokenisers.a_sizes[self.a]), np.cumsum(tokenisers.b_sizes[self.b])
        real = self.n_a > 0
        self.a_links, self.b_links, self.a_cut, self.b_cut = merge_lockstep(a_ends, b_ends, self.a_from[real], a_to[real])
        self.document = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_links = np.bincount(self.document[self.a_links], minlength=len(texts))
        self.n_groups = np.bincount(self.document[self.a_cut], minlength=len(texts))
        self.tokenisers = tokenisers

    def group_texts(self) -> Iterator[str]:
        """Ids by group of each document: A's, then B's, in the order of the text."""
        a_after, b_after = np.flatnonzero(self.a_cut) + 1, np.flatnonzero(self.b_cut) + 1
        a_group, b_group = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        wide, merged = self.tokenisers.wide, np.empty(len(self.a) + len(self.b), np.int32)
        if len(self.a):
            merged[np.arange(len(self.a)) + np.append(0, b_after)[a_group]] = self.a + np.where(self.a_cut, wide, 0)
            merged[np.arange(len(self.b)) + a_after[b_group]] = self.b + np.where(self.b_cut, 2 * wide, 0)
        shown, at = self.tokenisers.shown, 0
        for n in (self.n_a + self.n_b).tolist():
            yield "".join([shown[x] for x in merged[at:at + n].tolist()])[:-1]
            at += n

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs and the number of documents with each; then each document's pairs by their place among these, how many it has, and how often it has each."""
        found, place = np.unique(self.a[self.a_links].astype(np.int64) << BITS | self.b[self.b_links], return_inverse=True)
        own, often = np.unique(self.document[self.a_links] << BITS | place, return_counts=True)
        place = own & ((1 << BITS) - 1)
        return found, np.bincount(place, minlength=len(found)), place, np.bincount(own >> BITS, minlength=len(self.n_a)), often


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Documents of about ``CHUNK_BYTES`` of text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        column, start = batch.column("text"), 0
        sizes = column.cast(pa.binary())
        for row in range(batch.num_rows):
            text = column[row].as_py()
            more = len(sizes[row].as_py() or b"")
            if texts and size + more > CHUNK_BYTES:
                yield pa.concat_arrays([*ids, batch.column("doc_id").slice(start, row - start)]), texts
                ids, texts, size, start = [], [], 0, row
            texts.append(text)
            size += more
        ids.append(batch.column("doc_id").slice(start))
    if texts:
        yield pa.concat_arrays(ids), texts


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their first bytes before their second ones and so on: small numbers compress well this way."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


CHUNK_COLUMNS = "chunk long, keys array<long>, n_docs array<long>, n_own binary, own binary, often binary"
DOC_COLUMNS = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"


def _aligned_batches(batches: Iterator[pa.RecordBatch], spec, model) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its pairs, and a list per column of its documents."""
    task, tokenisers = TaskContext.get().partitionId(), None
    for number, (ids, texts) in enumerate(_chunks(batches)):
        tokenisers = tokenisers or Tokenisers(spec.value, model.value)
        chunk = Chunk(tokenisers, texts)
        keys, n_docs, own, n_own, often = chunk.pairs()
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in chunk.group_texts()]
        # Places ascend within a document, so their differences are small.
        steps = np.diff(own, prepend=0)
        first = (np.cumsum(n_own) - n_own)[n_own > 0]
        steps[first] = own[first]
        row = [[task << 32 | number], [keys.tolist()], [n_docs.tolist()], [_planes(n_own)], [_planes(steps)], [_planes(often)],
               [chunk.n_a.tolist()], [chunk.n_b.tolist()], [chunk.n_groups.tolist()], [chunk.n_links.tolist()], [digests]]
        long, many, text = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())
        kinds = [long, many, many, pa.binary(), pa.binary(), pa.binary(), many, many, many, many, text]
        names = "chunk keys n_docs n_own own often n_a n_b n_groups n_links groups_sha256".split()
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(row, kinds)], held], [*names, "doc_ids"])


def _summed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each chunk with their sums, from the chunk's pairs and what the corpus says of them."""
    names = "n_a n_b n_groups n_links groups_sha256".split()
    for batch in batches:
        for row in range(batch.num_rows):
            own = {name: batch.column(name)[row] for name in batch.schema.names}
            often, n_own = _unplanes(own["often"].as_py()), _unplanes(own["n_own"].as_py())
            place = _unplanes(own["own"].as_py())
            # Running sums that start anew with each document.
            to = np.cumsum(n_own)
            total = np.cumsum(place)
            at = np.where(to - n_own > 0, np.append(0, total)[to - n_own], 0)
            place = total - np.repeat(at, n_own)
            counts = np.array(own["counts"].as_py() or [], np.int64)
            n, best = counts >> 1, counts & 1

            def by_document(values):
                sums = np.append(0, np.cumsum(values))
                return pa.array(sums[to] - sums[to - n_own], pa.int64())

            yield pa.RecordBatch.from_arrays(
                [own["doc_ids"].values, *[own[c].values for c in names], by_document(best[place] * often), by_document(n[place] * often)],
                ["doc_id", *names, "n_best", "count_sum"])


def align_tokens(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.

    Links are all pairs of an A and a B token occurrence that share a byte, groups the stretches between byte offsets where tokens of both end. A pair of ids counts in how
    many documents it is linked; ``n_best`` is the number of links whose count is the highest of their A id, ties included. Texts that are null or empty, or that one of the two does not give
    back, have no tokens: zeros and an empty ``groups_sha256``. Rows with equal or null ids are documents of their own, texts of any length
    are read whole, an empty table gives no rows, and other columns are ignored.
    """
    sent, sent_model = docs.sparkSession.sparkContext.broadcast(spec), docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    chunks = materialise(named.mapInArrow(
        lambda batches: _aligned_batches(batches, sent, sent_model), f"{CHUNK_COLUMNS}, {DOC_COLUMNS}, doc_ids array<{kind}>"), "chunks")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "n_docs")).alias("place", "pair")).select(
        "chunk", "place", F.col("pair.keys").alias("key"), F.col("pair.n_docs").alias("n"))
    counts = materialise(pairs.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    a_id = F.shiftright("key", BITS)
    # One row per entry of A's vocabulary.
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("highest"))
    rated = counts.join(F.broadcast(highest), a_id == F.col("a")).select("key", (F.col("n") * 2 + (F.col("n") == F.col("highest")).cast("long")).alias("count"))
    # A chunk's pairs come back in the order in which it has them.
    told = pairs.select("chunk", "place", "key").join(rated, "key").groupBy("chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "count"))), lambda p: p["count"]).alias("counts"))
    return chunks.drop("keys", "n_docs").join(told, "chunk", "left").mapInArrow(
        _summed_batches, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _group_batches(batches: Iterator[pa.RecordBatch], spec, model) -> Iterator[pa.RecordBatch]:
    tokenisers = None
    for ids, texts in _chunks(batches):
        tokenisers = tokenisers or Tokenisers(spec.value, model.value)
        chunk = Chunk(tokenisers, texts)
        a_to, b_to = np.flatnonzero(chunk.a_cut) + 1, np.flatnonzero(chunk.b_cut) + 1
        document = chunk.document[a_to - 1]
        first = np.append(True, document[1:] != document[:-1])[:len(document)]
        place = np.arange(len(document)) - np.maximum.accumulate(np.where(first, np.arange(len(document)), 0))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(own, pa.int32())) for to, own in ((a_to, chunk.a), (b_to, chunk.b))]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(document)), pa.array(place, pa.int32()), *lists], ["doc_id", "place", "a_ids", "b_ids"])


def token_groups(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, a_ids, b_ids): the groups themselves, numbered from 0 in each document; documents without tokens have none."""
    sent, sent_model = docs.sparkSession.sparkContext.broadcast(spec), docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(lambda batches: _group_batches(batches, sent, sent_model), f"doc_id {kind}, place int, a_ids array<int>, b_ids array<int>")
