"""Span, line and byte removal, near duplicates, BPE and vector search against plain versions."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from rolefold.llm import near_dup, run_index
from rolefold.llm.bpe import WordBpe, encoded_digests, read_spec
from rolefold.llm.components import components
from rolefold.llm.lexicon import Lexicon, compile_lexicon
from rolefold.llm.near_dup import drop_near_duplicates, near_duplicates
from rolefold.llm.run_index import drop_repeated_bytes, repeated_ranges
from rolefold.llm.sentence_spans import drop_repeated_spans, sentences
from rolefold.llm.site_lines import drop_site_lines, host, page_lines
from rolefold.llm.vector_search import top_products

CLASH = "text_key int, row_key long, spans string, run long, anchor long, gone string, set_key string, root string, kept_text string"
BLANK = (1, 2, "x", 3, 4, "g", "k", "r", "t")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def frame(spark):
    return lambda rows, schema="doc_id long, text string": spark.createDataFrame([(*r, *BLANK) for r in rows], f"{schema}, {CLASH}")


def prose(seed, n_sentences):
    random.seed(seed)
    return " ".join(" ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(random.randrange(40))
                             for _ in range(random.randint(3, 14))).capitalize() + random.choice(".!?") for _ in range(n_sentences))


def corpus():
    passage = prose(1, 9)
    docs = [(i, prose(100 + i, 6 + i % 7)) for i in range(25)]
    docs += [(30 + i, prose(200 + i, 4) + " " + passage + "\n" + prose(300 + i, 3)) for i in range(8)]
    docs += [(50 + i, docs[3][1]) for i in range(6)]
    docs += [(60 + i, " ".join(w if k != 11 * i else "changed" for k, w in enumerate(docs[4][1].split()))) for i in range(1, 5)]
    docs += [(70, None), (71, ""), (72, "  \n "), (73, "one"), (74, "One"), (75, "two words"), (76, "é" * 300), (77, "é" * 90 + "漢" * 90), (78, "ab" * 4000)]
    docs += [(79, docs[2][1] + " " + docs[2][1]), (81, "tail " + docs[2][1])]
    return docs


def in_order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))


def test_repeated_spans(frame):
    docs = corpus() + [(None, corpus()[5][1])]
    expected = brute.span_removal([t for _, t in in_order(docs)], sentences)
    out = {r.doc_id: r for r in drop_repeated_spans(frame(docs)).collect()}
    assert len(out) == len(docs)
    for (i, text), gone in zip(in_order(docs), expected):
        parts = sentences(text)
        assert "".join(parts) == (text or "")
        kept = None if text is None else "".join(p for k, p in enumerate(parts) if k not in gone)
        assert (out[i].n_sentences, out[i].n_removed, out[i].kept_text) == (len(parts), len(gone), kept), i
    assert out[None].n_removed == out[None].n_sentences > 0


def test_repeated_bytes(frame):
    docs = corpus() + [(None, corpus()[5][1])]
    out = {r.doc_id: tuple(r)[1:] for r in drop_repeated_bytes(frame(docs)).collect()}
    assert out == {i: want for (i, _), want in zip(in_order(docs), brute.byte_removal([t for _, t in in_order(docs)]))}


def test_repeated_bytes_of_hot_anchors_and_long_texts(frame, monkeypatch):
    docs = [(i, prose(500 + i, 2) + " " + prose(1, 6) + prose(600 + i, 2)) for i in range(30)] + [(90, prose(7, 900)), (91, prose(8, 300) + prose(7, 900)[5000:9000])]
    expected = {i: want for (i, _), want in zip(docs, brute.byte_removal([t for _, t in docs]))}
    for name, value in (("HOT_CLASSES", 3), ("INDEX_BYTES", 2000), ("PIECE", 1500)):
        monkeypatch.setattr(run_index, name, value)
        assert {r.doc_id: tuple(r)[1:] for r in drop_repeated_bytes(frame(docs)).collect()} == expected


def test_repeated_bytes_of_tasks_that_send_often(frame, monkeypatch):
    """Classes are compared and sent many times within a task, with a text longer than what it holds."""
    docs = corpus() + [(None, corpus()[5][1]), (95, prose(7, 900)), (96, prose(7, 900)), (96, prose(7, 900))]
    expected = sorted(map(tuple, drop_repeated_bytes(frame(docs)).collect()), key=str)
    for fresh, kept in ((1, 1), (40, 70), (40, 10_000)):
        monkeypatch.setattr(run_index, "FRESH", fresh)
        monkeypatch.setattr(run_index, "KEPT", kept)
        monkeypatch.setattr(run_index, "PIECE", 2_000)
        assert sorted(map(tuple, drop_repeated_bytes(frame(docs).coalesce(1)).collect()), key=str) == expected


def test_memory_of_a_task_does_not_grow_with_its_texts():
    import pyarrow as pa

    held = []
    for n in (400, 1_600):
        table = pa.table({"doc_id": range(n), "text_key": range(n), "text": [prose(20_000 + i, 12) for i in range(n)]})
        most = 0
        saved, run_index.FRESH, run_index.KEPT = (run_index.FRESH, run_index.KEPT), 2_000, 4_000
        added = run_index._Classes.add

        def counted(self, *args):
            nonlocal most
            added(self, *args)
            most = max(most, self.n_fresh + len(self.firsts[0]))

        run_index._Classes.add = counted
        try:
            assert sum(b.num_rows for b in run_index._anchor_batches(iter(table.to_batches(max_chunksize=64)), pa.int64())) > 0
        finally:
            run_index._Classes.add, (run_index.FRESH, run_index.KEPT) = added, saved
        held.append(most)
    assert held[1] < 1.5 * held[0]


def test_run_index_streams_what_comparing_finds():
    random.seed(3)
    base = bytes(random.choice(b"ab") for _ in range(400))
    texts = [base[a:a + n] for a, n in ((0, 168), (20, 150), (0, 168), (100, 120), (250, 99), (240, 110))] + [b"a" * 160, b"a" * 130]
    places = np.array([5, 3, 1, 9, 2, 7, 8, 4]) << 32
    first, last = repeated_ranges(texts, places)
    place = {}
    for t, p in zip(texts, places):
        for k in range(len(t) - 99):
            place[t[k:k + 100]] = min(place.get(t[k:k + 100], 1 << 60), p + k)
    for t, p, a, z in zip(texts, places, first, last):
        hits = [k for k in range(len(t) - 99) if place[t[k:k + 100]] < p + k]
        assert (a, z) == ((hits[0], hits[-1]) if hits else (-1, -1))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(frame, width, percent):
    docs = corpus() + [(None, corpus()[6][1]), (None, "id less words here alone"), (82, "x"), (82, "x")]
    ids, sizes = brute.near_components(docs, width, percent)
    out = collections.Counter(tuple(r) for r in near_duplicates(frame(docs), width, percent).collect())
    empty = lambda n, i: i if n == 0 else None
    assert out == collections.Counter(
        (i, n, c if n else empty(n, i), (i == c if i is not None else c is None)) for (i, _), n, c in zip(docs, sizes, ids))


def test_one_of_each_group_stays(frame):
    docs = corpus() + [(3, corpus()[3][1])] * 2
    kept = drop_near_duplicates(frame(docs))
    assert kept.columns == frame(docs).columns
    ids, sizes = brute.near_components(docs, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c if n else i for (i, _), c, n in zip(docs, ids, sizes)})


@pytest.mark.parametrize("last, share", [(3, 2), (6, 0.5)])
def test_crowds_are_compared_in_chunks_with_their_centres(frame, monkeypatch, last, share):
    words = prose(11, 60).split()
    docs = [(0, " ".join(words))]
    for i in range(1, 90):
        random.seed(i)
        mine = list(words)
        for k in random.sample(range(len(words)), len(words) // 70):
            mine[k] = f"own{i}x{k}"
        docs.append((i, " ".join(mine)))
    for name, value in (("SMALL", 6), ("CHUNK", 20), ("LAST_DEPTH", last), ("CROWD", share)):
        monkeypatch.setattr(near_dup, name, value)
    ids, _ = brute.near_components(docs, 3, 85)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(docs)).collect()} == {i: c for (i, _), c in zip(docs, ids)}


def two_groups_with_one_bridge(each, beside=10):
    """Two dense groups, about 0.75 similar. One document of each is linked to one of the other, and has nearer ones of its own group beside it."""
    places = range(10, 586, 24)
    free = [k for k in range(3, 597) if min(abs(k - p) for p in places) > 4]
    docs = []
    for group in (0, 1):
        for i in range(each):
            random.seed(1000 * group + i)
            mine = [f"w{k}" for k in range(600)]
            other = places if group else []
            if i >= each - 1 - beside:
                other = places[7:] if group else places[7:14]
            for k in other:
                mine[k] = f"other{k}"
            for k in random.sample(free, 6 if each - 1 - beside <= i < each - 1 else 2):
                mine[k] = f"own{group}x{i}x{k}"
            docs.append((each * group + i, " ".join(mine)))
    return docs


def test_a_single_bridge_between_dense_groups_is_found(frame):
    docs = two_groups_with_one_bridge(110)
    ids, _ = brute.near_components(docs, 3, 85)
    assert set(ids) == {0}
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(docs)).collect()} == {i: c for (i, _), c in zip(docs, ids)}


def test_small_groups_and_a_chain_in_a_crowd_of_several_chunks_are_found(frame, monkeypatch):
    """Around one large component: pairs, triples and a chain that are linked with each other only, in the same nodes as it."""
    docs = []

    def add(start, end, own):
        mine = [f"other{k}" if start <= n < end else f"w{k}" for n, k in enumerate(range(600))]
        for k in own:
            mine[k] = f"own{len(docs)}x{k}"
        docs.append((len(docs), " ".join(mine)))

    random.seed(9)
    for _ in range(60):
        add(0, 0, random.sample(range(300), 3))
    for group in range(6):
        for _ in range(2 + group % 2):
            add(310 + 40 * group, 346 + 40 * group, random.sample(range(300), 2))
    for step in range(8):
        add(10 * step, 10 * step + 110, random.sample(range(320, 600), 2))
    for name, value in (("SMALL", 6), ("CHUNK", 6), ("FIRST_DEPTH", 0), ("LAST_DEPTH", 0), ("CENTRES", 1)):
        monkeypatch.setattr(near_dup, name, value)
    ids, _ = brute.near_components(docs, 3, 85)
    assert len(set(ids)) > 4
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(docs)).collect()} == {i: c for (i, _), c in zip(docs, ids)}


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (3, 2), (2, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_site_lines(frame):
    rows = [(i, f"https://user@Big.Example.org:80/{i}", f"<p>Menu</p><div> own {i} </div>text<br>text\nlast {i % 2}<!-- Menu --><script>x</script>") for i in range(12)]
    rows += [(20, "http://small.example/1", "<p>Menu</p>"), (21, None, "Menu\nMenu"), (22, "no url", "Menu"), (23, "https://big.example.org/x", None), (24, "https://big.example.org/y", "")]
    pages = frame(rows, "page_id long, url string, html string").withColumn("all_lines", F.lit("clash")).withColumn("site", F.lit(1))
    out = {r.page_id: r for r in drop_site_lines(pages, host(F.col("url")), page_lines(F.col("html"))).collect()}
    lines = {i: out[i].all_lines for i in out}
    assert lines[3] == ["Menu", "own 3", "text", "text", "last 1"] and lines[23] == [] and lines[21] == ["Menu", "Menu"]
    sites = [("big.example.org" if i < 20 or i > 22 else "small.example" if i == 20 else None, lines[i]) for i in sorted(out)]
    for i, kept in zip(sorted(out), brute.site_lines(sites)):
        assert out[i].kept_lines == kept and out[i].n_dropped == len(lines[i]) - len(kept)
    assert out[3].kept_lines == ["own 3"]


def test_bpe_orders_marks_as_the_library():
    import unicodedata
    library, bpe = Tokenizer.from_file(TOKENIZER), WordBpe(read_spec(TOKENIZER))
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    random.seed(8)
    texts = ["".join([random.choice("aeqßé"), *random.choices(marks, k=3)]) for _ in range(20_000)]
    own = [[i for piece in bpe.pre_tokens(t) for i in bpe.merge(piece)] for t in texts]
    assert own == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library(frame):
    library = Tokenizer.from_file(TOKENIZER)
    random.seed(4)
    pool = [chr(c) for c in range(32, 0x2FFF)] + list("abcdeABC '\"sdtmrevl  \n\t") * 400 + ["<|endoftext|>", "<|startoftext|>", "'s", "ΑΣ", "😀"] * 40
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(400)] + [None, "", " ", "x" * 5000, "<|endoftext|>" * 3, "café ÉTÉ"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    for r in encoded_digests(frame(docs), TOKENIZER).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), __import__("hashlib").sha256(packed).hexdigest()), texts[r.doc_id]
        assert r.decoded_sha256 == brute.digest(library.decode(ids, skip_special_tokens=False))


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    bpe = WordBpe(read_spec(TOKENIZER))
    words = [a + b for a in ("walk", "talk", "jump", "é") for b in ("", "s", "ed", "ing", "ings")]
    data = compile_lexicon({w.encode(): bpe.merge(w.encode()) for w in words})
    (tmp_path / "lexicon").write_bytes(data)
    lexicon = Lexicon(str(tmp_path / "lexicon"))
    numbers = lexicon.numbers([w.encode() for w in words])
    assert sorted(numbers) == list(range(len(words)))
    for w, n in zip(words, numbers):
        assert np.frombuffer(lexicon.packed_ids(n), "<u4").tolist() == bpe.merge(w.encode())
    assert lexicon.numbers([b"", b"wal", b"walkin", b"zz", "é".encode()[:1], b"walks" * 40]).tolist() == [-1] * 6
    assert int(np.frombuffer(data[:4], np.uint32)[0]) < sum(map(len, words)) / 4
    (tmp_path / "empty").write_bytes(compile_lexicon({}))
    assert Lexicon(str(tmp_path / "empty")).numbers([b"x"]).tolist() == [-1]


def test_merges_together_equal_merges_alone():
    bpe = WordBpe(read_spec(TOKENIZER))
    random.seed(9)
    pieces = [bytes(random.choice(b"aabehinrstu\xc3\xa9!") for _ in range(random.randint(1, 80))) for _ in range(3000)] + [b"a" * 64, b"a" * 65]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_all(pieces)] == [bpe.merge(p) for p in pieces]
    assert bpe.merge_all([]) == []


def test_vector_search(frame):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.1, (300, 24)).astype(np.float32)
    vectors[40:60] = vectors[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows[200] = (200, None)
    rows[13] = (13, [None] * 24)
    rows[14] = (14, [float("nan")] * 24)
    rows[15] = (15, [float("-inf")] * 24)
    rows += [(400, [0.5, 0.25]), (401, [1.0, -1.0]), (None, rows[1][1]), rows[3], rows[3]]
    out = {tuple(r) for r in top_products(frame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()}
    keep = np.array([i for i in range(300) if i not in (200, 13, 14, 15)])
    whole = np.floor(1024 * vectors[keep].astype(float)).astype(np.int64)
    expected = brute.top_products(whole, keep, [int(np.flatnonzero(keep == q)[0]) for q in (0, 100)])
    assert out == expected | {(400, 1, 401, 512 * 1024 - 256 * 1024)}


@pytest.mark.parametrize("operator", [drop_repeated_spans, drop_repeated_bytes, near_duplicates, drop_near_duplicates, lambda d: encoded_digests(d, TOKENIZER)])
def test_empty_table(frame, operator):
    assert operator(frame([])).collect() == []


def test_empty_pages_and_vectors(frame):
    pages = frame([], "page_id long, url string, html string")
    assert drop_site_lines(pages, host(F.col("url")), page_lines(F.col("html"))).collect() == []
    assert top_products(frame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []
