"""Token alignment against plain loops over the two public libraries."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rolefold.llm import alignment
from rolefold.llm.alignment import align_tokens, merge_lockstep, token_groups
from rolefold.llm.bpe import read_spec

PATH, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPEC, PIECES = read_spec(PATH), open(MODEL, "rb").read()
CLASH = "chunk long, keys string, place int, key long, n long, counts string, n_a string"
BLANK = (1, "k", 2, 3, 4, "c", "x")


def letters():
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(others)): b for b in range(256)}


def tokens(text):
    """(id, bytes) lists of both, empty where they do not give back a blank and the text."""
    if not text:
        return [], []
    library, pieces, byte = Tokenizer.from_file(PATH), sentencepiece.SentencePieceProcessor(model_file=MODEL), letters()
    library.encode_special_tokens = True
    a = [(i, bytes(byte[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pieces.encode(text):
        piece = pieces.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("\u2581", " ").encode()))
    data = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == data else ([], [])


def aligned(texts):
    found, counts = [], collections.Counter()
    for text in texts:
        a, b = tokens(text)
        spans = []
        for own in (a, b):
            ends = np.cumsum([len(x) for _, x in own]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], 0
        for cut in cuts:
            groups.append(tuple([i for (i, _), (s, e) in zip(own, sp) if at <= s and e <= cut] for own, sp in zip((a, b), spans)))
            at = cut
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(set(pairs))
        found.append((a, b, groups, pairs))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, groups, pairs in found:
        shown = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(pairs), hashlib.sha256(shown.encode()).hexdigest() if a else "",
                    sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs)))
    return out, [g for _, _, g, _ in found]


def corpus():
    random.seed(11)
    words = ["alpha", "Übermut", "naïve", "don't", "x1", "2024", "漢字", "\n", "  ", "🙂", "the", "of", "hello<s>", "<0x41>", "<|endoftext|>", "\t", "e\u0301"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(1, 40))) for _ in range(60)]
    texts += [None, "", " ", "a", "\u2581 stands for a blank", "x\u2581y", "the same", "the same", "the same", "\x00", "  two blanks", "ﬁ"]
    return texts + [" ".join(random.choice(words) for _ in range(700)), "ひらがな" * 150]


def run(spark, texts):
    docs = [(k if k % 9 else None, t, *BLANK) for k, t in enumerate(texts)]
    rows = align_tokens(spark.createDataFrame(docs, f"doc_id long, text string, {CLASH}").repartition(3), SPEC, PIECES).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in rows)


@pytest.mark.parametrize("chunk,lane", [(4 << 20, 256), (300, 4), (1, 1)])
def test_alignment(spark, monkeypatch, chunk, lane):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "LANE", lane)
    texts = corpus()
    expected, _ = aligned(texts)
    assert run(spark, texts) == sorted((k if k % 9 else -1, *row) for k, row in enumerate(expected))
    assert sum(row[0] > 0 for row in expected) > 60 and sum(row[0] == 0 for row in expected) >= 4


def test_groups_themselves(spark):
    texts = corpus()[40:]
    rows = token_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SPEC, PIECES).collect()
    own = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.place)):
        assert r.place == len(own[r.doc_id])
        own[r.doc_id].append((list(r.a_ids), list(r.b_ids)))
    assert [own[k] for k in range(len(texts))] == aligned(texts)[1]


def test_empty_and_without_tokens(spark):
    assert run(spark, []) == []
    assert run(spark, ["x", None, ""]) == sorted((k if k % 9 else -1, *row) for k, row in enumerate(aligned(["x", None, ""])[0]))
    assert [r[1:] for r in run(spark, [None, ""])] == [(0, 0, 0, 0, "", 0, 0)] * 2


def test_lockstep_steps_follow_the_lanes(monkeypatch):
    """A long text among short ones is merged in as many steps as a lane has links, not as the text has."""
    random.seed(2)
    a = np.cumsum([random.randint(1, 6) for _ in range(40_000)])
    b = np.unique(np.append(np.cumsum([random.randint(1, 6) for _ in range(60_000)]), a[-1]))
    b = b[b <= a[-1]]
    steps = []
    concatenate = np.concatenate
    monkeypatch.setattr(alignment.np, "concatenate", lambda parts, **rest: steps.append(len(parts)) or concatenate(parts, **rest))
    a_links, b_links, a_cut, b_cut = merge_lockstep(a, b, np.array([0]), np.array([len(a)]))
    monkeypatch.undo()
    assert max(steps) < 2_000 < len(a_links)
    both = np.union1d(a, b)
    assert sorted(zip(a_links.tolist(), b_links.tolist())) == list(zip(np.searchsorted(a, both).tolist(), np.searchsorted(b, both).tolist()))
    assert (a[a_cut] == np.intersect1d(a, b)).all() and (b[b_cut] == np.intersect1d(a, b)).all()
