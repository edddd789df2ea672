"""Pattern packing: pieces against the tokenizers library, the plan against counts and bounds."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolefold.llm import byte_bpe, packing
from rolefold.llm.bpe import read_spec
from rolefold.llm.packing import best_fit, fitted_counts, pack_documents, packed_sequences, packing_plan, patterns_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = read_spec(PATH)
CLASH = "piece int, size int, task int, nth long, sequence_id string, rank long, n long, before long, slot int"
BLANK = (1, 2, 3, 4, "s", 5, 6, 7, 8)


def corpus():
    random.seed(5)
    docs = [(i, " ".join(random.choice(["alpha", "beta7", "  x", "é", "漢字", "\n\n", "don't"]) for _ in range(random.randint(1, 900)))) for i in range(150)]
    docs += [(200 + i, "the same short text") for i in range(80)]
    docs += [(300, None), (301, ""), (302, "<|endoftext|>a <|endoftext|> <|endo"), (303, "word " * 30_000), (304, " " * 60_000), (None, "no id"), (None, None)]
    return docs + [(305, "a" * 1023 * 3)] * 3


def expected_pieces(docs, capacity=1024):
    library, out = Tokenizer.from_file(PATH), collections.Counter()
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [len(ids) - k for k in range(0, len(ids), capacity)][::-1]
        for piece, (a, z) in enumerate(zip([0, *cuts], cuts)):
            out[i, piece, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    return out


def full(rows, capacity):
    """Pieces by sequence, which they fill without gaps."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def test_pieces_and_places(spark):
    docs = corpus()
    rows = pack_documents(spark.createDataFrame([(*d, *BLANK) for d in docs], f"doc_id long, text string, {CLASH}").repartition(3), SPEC).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(docs)
    held = full(rows, 1024)
    assert len(held) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


@pytest.mark.parametrize("capacity", [16, 3000])
def test_other_capacities_keep_their_ids(spark, capacity):
    docs = corpus()[:60] + [(400, None)]
    packed = pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), SPEC, capacity, keep_ids=True)
    rows = packed.collect()
    cut = capacity // -(-capacity // 1024) * -(-capacity // 1024)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(docs, cut)
    held = full(rows, capacity)
    texts = {r.sequence_id: r for r in packed_sequences(packed).collect()}
    assert texts.keys() == held.keys()
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in rows}
    for r in texts.values():
        assert bytes(r.ids) == b"".join(ids[p.doc_id, p.piece] for p in r.pieces) and len(r.ids) == 4 * sum(p.length for p in r.pieces)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), SPEC).collect() == []


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(1)
    some = np.bincount(rng.integers(1, 1024, 6000), minlength=1025)
    for counts in (some, some * 40, some + np.bincount([1], minlength=1025) * 3000, some + np.bincount([500], minlength=1025) * 5000,
                   np.bincount(rng.integers(600, 1025, 500), minlength=1025), np.bincount([3, 3, 1024], minlength=1025), np.zeros(1025, np.int64)):
        plan, got = packing_plan(counts, 1024), np.zeros(1025, np.int64)
        for content, number in plan:
            assert sum(c * n for c, n in content) <= 1024
            for c, n in content:
                got[c] += n * number
        assert (got == counts).all()
        assert sum(n for _, n in plan) <= 1.015 * sum(n for _, n in best_fit(counts, 1024)) + 1
        assert len(plan) < 5000


def test_patterns_and_fit():
    every = patterns_of(12, np.ones(13, bool)).tolist()
    exact = [[a, b, 12 - a - b] for a in range(1, 12) for b in range(a + 1) if 0 <= 12 - a - b <= b]
    assert sorted(every) == sorted(exact + [[a, n - a, 0] for n in range(8, 12) for a in range(1, n) if n - a <= a])
    counts = np.zeros(13, np.int64)
    counts[[3, 4, 5, 6]] = (10, 25, 10, 8)
    patterns = patterns_of(12, counts > 0)
    amounts = fitted_counts(patterns, counts)
    used = np.zeros(13)
    for p, n in zip(patterns, amounts):
        np.add.at(used, p, n)
    assert (amounts >= 0).all() and np.abs(used[1:] - counts[1:]).sum() < 0.01 * counts.sum()


def test_fast_ids_are_those_of_the_library():
    library, plain = Tokenizer.from_file(PATH), Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    random.seed(9)
    texts = ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x80, 0xD800), random.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(3000)]
    texts += ["a<|endoftext|> b", "  \n \t x  ", "I'll don't 's"]
    for special, own in ((True, library), (False, plain)):
        bpe = byte_bpe.ByteBpe(SPEC, special)
        assert [bpe.encode(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    run = " " * 2_000_000 + "x"      # too long for the faster library's pattern
    assert byte_bpe.ByteBpe(SPEC, True).encode(run) == library.encode(run, add_special_tokens=False).ids
