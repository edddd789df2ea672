"""Substring dedup by sliding spans of sentences.

The shortest run of at least two consecutive sentences with at least ``LEAST_WORDS`` words is hashed from each sentence on, and that up to
each sentence; so the runs inside a passage cover it from end to end. A run that occurs anywhere before, in a document with
a smaller id or earlier in the same one, is a repetition; the sentences it covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

LEAST_SENTENCES, LEAST_WORDS = 2, 20
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: A sentence ends with the blanks after a full stop, question or exclamation mark, or with a line.
_SENTENCE = regex.compile(r"[^.!?\n]*(?:[.!?](?![\x20\x09-\x0D])[^.!?\n]*)*(?:[.!?][\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*|$)")


def sentences(text: str | None) -> list[str]:
    """Pieces that make up the whole text; blanks belong to the sentence before them."""
    return [s for s in _SENTENCE.findall(text or "") if s]


def span_runs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hash, first piece and length in pieces of each run; pieces without words belong to a run but begin none."""
    parts = [p.encode("utf-8", "surrogatepass").split() for p in pieces]
    n_words = np.fromiter(map(len, parts), np.int64, len(parts))
    real = np.flatnonzero(n_words)
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(parts[i])) for i in real), np.uint64).reshape(-1, 2)
    total = np.concatenate([[0], np.cumsum(n_words[real])])
    at = np.arange(len(real))
    until = np.maximum(np.searchsorted(total, total[:-1] + LEAST_WORDS), at + LEAST_SENTENCES)
    since = np.minimum(np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1, at + 1 - LEAST_SENTENCES)
    both = np.unique(np.concatenate([(at * (len(real) + 1) + until)[until <= len(real)], (since * (len(real) + 1) + at + 1)[since >= 0]]))
    at, last = both // (len(real) + 1), both % (len(real) + 1)
    runs = []
    with np.errstate(over="ignore"):
        for half, factor in zip(hashes.T, _FACTORS):
            powers = np.cumprod(np.full(len(real), factor, np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(half * powers, dtype=np.uint64)])
            inverse = np.cumprod(np.full(len(real), pow(factor, -1, 2**64), np.uint64))
            runs.append(((sums[last] - sums[at]) * (inverse[at] if len(at) else np.empty(0, np.uint64)) + (last - at).astype(np.uint64)).view(np.int64))
    first = real[at]
    return *runs, first, real[last - 1] - first + 1


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [span_runs(sentences(x.as_py())) for x in part.column("text")]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            run, run_too, first, size = (np.concatenate([f[k] for f in found]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("text_key").take(rows), pa.array(run, pa.int64()),
                 pa.array(run_too, pa.int64()), pa.array(first, pa.int32()), pa.array(size, pa.int32())],
                ["doc_id", "text_key", "run", "run_too", "at", "size"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts, n_all, n_cut, n_spans = [], [], [], []
            for text, spans in zip(part.column("text"), part.column("spans")):
                whole, marks = text.as_py(), spans.as_py() or []
                pieces = sentences(whole)
                gone = np.zeros(len(pieces) + 1, np.int64)
                for span in marks:
                    gone[span["at"]] += 1
                    gone[span["at"] + span["size"]] -= 1
                cut = np.cumsum(gone)[:-1] > 0
                texts.append("".join(p for p, c in zip(pieces, cut) if not c) if marks else whole)
                n_all.append(len(pieces))
                n_cut.append(int(cut.sum()))
                n_spans.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_all, n_cut, n_spans)), pa.array(texts, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "n_spans", "kept_text"])


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_sentences, n_removed, n_spans, kept_text), one per row of ``docs``; spans are maximal removed runs.

    Only blanks may differ between equal sentences. Null texts stay null, empty ones empty; both have no sentences. Documents without an id come last in the
    order of ids; documents with one id come in the order of a hash of their texts; rows equal in id and text are one document and have the same result. Other
    columns are ignored, and an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    runs = named.mapInArrow(_run_batches, f"doc_id {kind}, text_key long, run long, run_too long, at int, size int")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "at")
    # Partial sums come first, so a passage that a third of all documents share is one row per task here. They are written, as adaptive execution
    # only splits such a passage's rows in a join whose sides are both plain shuffles.
    first = materialise(
        runs.groupBy("run", "run_too").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("run", "run_too", "first"), "repeated-runs")
    again = runs.join(first, ["run", "run_too"]).where(place != F.col("first"))
    spans = again.groupBy(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key")).agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    whole = named.join(spans, named["doc_id"].eqNullSafe(spans["cut_id"]) & (named["text_key"] == spans["cut_key"]), "left")
    return whole.select("doc_id", "text", "spans").mapInArrow(
        _cut_batches, f"doc_id {kind}, n_sentences long, n_removed long, n_spans long, kept_text string")
