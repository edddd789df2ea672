"""BPE encoding and decoding with a lexicon of frequent words and exact merges for the others.

The corpus is counted once, as whole; its most frequent pre-tokens are merged on the driver and compiled into a minimal
acyclic transducer. Executors fetch its file and map it into memory. A pre-token outside it is merged in the task, by the same merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..session import materialise, run_dir
from .common import words
from .lexicon import LONGEST, Lexicon, byte_matrix, compile_lexicon

LEXICON_WORDS = 50_000     # most frequent pre-tokens in the lexicon; only speed depends on it
WORDS_CACHED = 150_000     # of a task in each of two generations; the older one is forgotten when the younger is full
AT_ONCE = 512              # texts
MARKS = frozenset(".,;:!?|")
WORD_END = "</w>"

# Blanks of the tokenizer's patterns; letters and numbers newer than Unicode 16, which its patterns do not know; letters
# whose lower case is newer than Unicode 15 (first, last, distance); combining marks that its normaliser does not know and so never moves.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
NEW_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
NEW_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 "
    "10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 "
    "16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
NEW_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def _spans(listed: str) -> str:
    """The inside of a character class from listed code points and ranges."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in listed.split())


def _without(category: str, newer: str) -> str:
    """A category without the code points that a tokenizer of the time does not know."""
    return f"[{category}--[{_spans(newer)}]]"


def _lower_table() -> dict[int, int]:
    """What is lower-cased unlike in a whole string: letters go one by one, so a sigma never becomes a final one."""
    return {ord("Σ"): ord("σ")} | {c: c + by for first, last, by in NEW_LOWER for c in range(first, last + 1)}


def _byte_letters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others are numbered from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordBpe:
    """The merges of a tokenizer file with word ends, lower case and byte-level letters."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END:
            raise ValueError("a BPE tokenizer with word ends is expected")
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b])
            for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        letters = _byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + WORD_END] for c in letters]
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for known, own in ((r"\s", SPACE), (r"\p{L}", _without(r"\p{L}", NEW_LETTERS)), (r"\p{N}", _without(r"\p{N}", NEW_NUMBERS))):
            pattern = pattern.replace(known, own)
        self.pieces = regex.compile(pattern, regex.V1)
        self.lower = _lower_table()
        self.unlike = re.compile("[" + "".join(map(chr, self.lower)) + "]")
        self.words = re.compile(f"[^{SPACE}]+")
        self.marks = re.compile(f"([{_spans(NEW_MARKS)}])")
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, ranked = (np.array(x, np.int64) for x in zip(*pairs))
        self.merged = np.empty(len(pairs) + 1, np.int64)
        self.merged[self.pair_ranks] = ranked
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    def pre_tokens(self, word: str) -> list[bytes]:
        """Normalised pieces of a text without special tokens."""
        text = word
        if not word.isascii():
            # A mark that the tokenizer does not know stays where it is, and nothing moves across it.
            text = "".join([unicodedata.normalize("NFC", part) for part in self.marks.split(word)])
            text = text.translate(self.lower) if self.unlike.search(text) else text
        text = text.lower()
        # Letters make one piece, and one mark after them makes another.
        if text.isalpha():
            return [text.encode()]
        if text[-1:] in MARKS and text[:-1].isalpha():
            return [text[:-1].encode(), text[-1].encode()]
        return [p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(text)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: of all pairs with a rule, that with the lowest rank is merged, the leftmost first."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.final[piece[-1]]]
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(*self.merges[pair], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.merges]
        heap = [(rank, k, new) for rank, new, k in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new = heapq.heappop(heap)
            after = right[k] if ids[k] >= 0 else -1
            if after < 0 or self.merges.get((ids[k], ids[after]), (0, -1))[1] != new:
                continue
            ids[k], ids[after], right[k] = new, -1, right[after]
            if right[k] >= 0:
                left[right[k]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.merges:
                    rank, merged = self.merges[ids[a], ids[b]]
                    heapq.heappush(heap, (rank, a, merged))
        return [i for i in ids if i >= 0]


    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the rule of each pair, or the number of rules."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], len(self.pair_keys))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pieces. All take their next merge together: each its pair of lowest rank, the leftmost first."""
        out: list[bytes] = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if len(p) <= LONGEST]
        for k in set(range(len(pieces))) - set(short):
            out[k] = np.array(self.merge(pieces[k]), "<u4").tobytes()
        short.sort(key=lambda k: len(pieces[k]))
        inner, final = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        for at in range(0, len(short), 4096):
            group = short[at:at + 4096]
            data, sizes = byte_matrix([pieces[k] for k in group])
            row, column = np.arange(len(group)), np.arange(data.shape[1] + 1)
            ids = np.full((len(group), data.shape[1] + 1), -1)
            ids[:, :-1] = np.where(column[:-1] < sizes[:, None], inner[data], -1)
            ids[row, sizes - 1] = final[data[row, sizes - 1]]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            live, none, width = row, len(self.pair_keys), ids.shape[1]
            while len(live) and width > 1:
                own, own_ranks = ids[live, :width], ranks[live, :width - 1]
                best = own_ranks.argmin(1)
                rank = own_ranks[np.arange(len(live)), best]
                going = rank < none
                live, own, own_ranks, best, rank = live[going], own[going], own_ranks[going], best[going], rank[going]
                each = np.arange(len(live))
                own[each, best] = self.merged[rank]
                follow = np.minimum(column[:width] + (column[:width] > best[:, None]), width - 1)
                own = np.take_along_axis(own, follow, 1)
                own[:, -1] = -1
                own_ranks = np.take_along_axis(own_ranks, np.minimum(follow[:, :-1], width - 2), 1)
                own_ranks[:, -1] = none
                own_ranks[each, best] = self._ranks(own[each, best], own[each, np.minimum(best + 1, width - 1)])
                before = np.flatnonzero(best > 0)
                own_ranks[before, best[before] - 1] = self._ranks(own[before, best[before] - 1], own[before, best[before]])
                ids[live, :width], ranks[live, :width - 1] = own, own_ranks
            used = ids >= 0
            packed, ends = ids[used].astype("<u4").tobytes(), np.cumsum(used.sum(1)) * 4
            start = 0
            for k, end in zip(group, ends.tolist()):
                out[k] = packed[start:end]
                start = end
        return out


class _Encoder:
    """Packed ids of texts; words are known by their packed ids once seen."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.young) > WORDS_CACHED:
            self.young, self.old = {}, self.young
        missing = []
        for word in words - self.young.keys():
            packed = self.old.get(word)
            if packed is None:
                missing.append(word)
            else:
                self.young[word] = packed
        taken = [self.bpe.pre_tokens(w) for w in missing]
        pieces = list({p for pieces in taken for p in pieces})
        numbers = self.lexicon.numbers(pieces).tolist()
        ids = {p: self.lexicon.packed_ids(n) for p, n in zip(pieces, numbers) if n >= 0}
        unseen = [p for p, n in zip(pieces, numbers) if n < 0]
        ids.update(zip(unseen, self.bpe.merge_all(unseen)))
        for word, own in zip(missing, taken):
            self.young[word] = ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = self.bpe.specials.split if self.bpe.specials is not None else lambda text: [text]
        parts = [split(text) for text in texts]      # every second part is a special token
        words = [[self.bpe.words.findall(part) for part in own[::2]] for own in parts]
        self._learn({w for own in words for part in own for w in part})
        known = self.young.__getitem__
        out = []
        for own, found in zip(parts, words):
            packed = [b"".join(map(known, part)) for part in found]
            for k, special in enumerate(own[1::2]):
                packed[k] += np.array([self.bpe.special[special]], "<u4").tobytes()
            out.append(b"".join(packed))
        return out


def _count_pieces(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    """(piece, n) from (word, n); a word is taken apart once per task, however often it occurs."""
    bpe = WordBpe(spec.value)
    for batch in batches:
        counts: dict[bytes, int] = {}
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            for piece in bpe.pre_tokens(word):
                counts[piece] = counts.get(piece, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["piece", "n"])


def _encode_batches(batches: Iterator[pa.RecordBatch], spec, lexicon: str) -> Iterator[pa.RecordBatch]:
    encoder = None
    for batch in batches:
        encoder = encoder or _Encoder(WordBpe(spec.value), Lexicon(SparkFiles.get(lexicon)))
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            ids = pa.array(encoder.encode_all([x or "" for x in part.column("text").to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    tokens = None
    for batch in batches:
        tokens = tokens or WordBpe(spec.value).tokens
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [" ".join([tokens[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def build_lexicon(docs: DataFrame, spec: str, size: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Name of the lexicon file of a corpus, which executors get by ``SparkFiles``.

    Words are counted before any Python runs; Python sees each task's distinct words. The driver gets the most frequent pieces, ``size`` at most.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(spec)
    counted = docs.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pieces = counted.mapInArrow(lambda batches: _count_pieces(batches, sent), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # Sixteen classes of frequency to an octave: about a thousand rows tell from which class on there are ``size`` pieces at most.
    pieces = materialise(pieces.withColumn("class", F.floor(F.log2("n") * 16).cast("int")), "pieces")
    least, room = None, size
    for row in sorted(pieces.groupBy("class").agg(F.count(F.lit(1)).alias("pieces")).collect(), reverse=True):
        room -= row["pieces"]
        if room < 0:
            break
        least = row["class"]
    frequent = [] if least is None else [bytes(r["piece"]) for r in pieces.where(F.col("class") >= least).select("piece").collect()]
    bpe = WordBpe(spec)
    name = f"lexicon-{uuid.uuid4().hex}"
    # Through the file system of the shared folder, from where executors fetch it, new ones after a loss as well.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir(spark, 'lexicon')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(compile_lexicon({p: bpe.merge(p) for p in frequent if len(p) <= LONGEST})))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_documents(docs: DataFrame, spec: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids), one per row of ``docs``; ``ids`` are little-endian unsigned 32-bit numbers.

    Special tokens in a text become their ids. Null and empty texts give no ids; texts of any length are encoded whole. Repeated rows are
    encoded alike, other columns are ignored, and an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(lambda batches: _encode_batches(batches, sent, lexicon), f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, spec: str) -> DataFrame:
    """Rows (doc_id, ids) with ``decoded``: the tokens of the ids, parted by blanks, as the file names no decoder."""
    sent = encoded.sparkSession.sparkContext.broadcast(spec)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decode_batches(batches, sent), f"doc_id {kind}, ids binary, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per row of ``docs``; see ``encode_documents``."""
    spec = read_spec(path)
    done = decode_documents(encode_documents(docs, spec, build_lexicon(docs, spec)), spec)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
