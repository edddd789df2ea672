"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_tokens
from .bpe import encoded_digests, read_spec
from .common import table
from .credentials import scan_secrets
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack_documents
from .prefix_trie import rebuilt_trie
from .quality import judge
from .run_index import drop_repeated_bytes
from .sentence_spans import drop_repeated_spans
from .sharding import shard_documents
from .site_lines import BLOCK_TAGS, drop_site_lines, host, page_lines
from .vector_search import top_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


@query
def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cleaned = drop_site_lines(pages, host(F.col("url")), page_lines(F.col("html")))
    return cleaned.select(
        "page_id", host(F.col("url")).alias("host"), F.size("all_lines").cast("long").alias("n_lines"), "n_dropped",
        F.array_join("kept_lines", "\n").alias("kept_text"))


# Dialect of the SQL: ranges are spelled out, and the pattern of blanks holds for trimming as well.
ORACLES["op7_site_lines"] = r"""
WITH page AS (
  SELECT row_number() OVER () AS k, page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '""" + BLOCK_TAGS + r"""', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
      lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
line AS (SELECT k, host, unnest(list_distinct(lines)) AS line FROM page WHERE host IS NOT NULL),
bad AS (
  SELECT l.host, list(l.line) AS lines
  FROM (SELECT host, line, count(*) AS n FROM line GROUP BY ALL HAVING count(*) >= 4) l
  JOIN (SELECT host, count(*) AS n FROM page GROUP BY host) t ON l.host = t.host AND l.n > 0.1 * t.n
  GROUP BY l.host),
kept AS (SELECT page_id, page.host, page.lines, list_filter(page.lines, lambda x: NOT coalesce(list_contains(bad.lines, x), false)) AS kept
  FROM page LEFT JOIN bad ON page.host = bad.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS kept_text FROM kept
"""


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_credential_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents"))


@query
def op8_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


@query
def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("byte_bpe_50k.json")))


@query
def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    aligned = align_tokens(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("byte_bpe_50k.json")), model)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_WORD = r"[^\x20\x09-\x0D]+"

ORACLES["op5_rule_cascade"] = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lined AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
win AS (SELECT k, i, w[i:i + 4] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
dup AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM dup) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals
  FROM lined LEFT JOIN rep ON rep.k = lined.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR 4 * n_symbols > n_words
       OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_capitals > word_chars) AS kept FROM m"""

ORACLES["op8_segment_bounds"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER w::INTEGER AS rank, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 10""".replace("row_number() OVER w::INTEGER", "CAST(row_number() OVER w AS INTEGER)")

ORACLES["op10_near_duplicates"] = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS d, doc_id AS top FROM t UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.d)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN (SELECT d, min(top) AS component_id FROM r GROUP BY d) c ON c.d = t.doc_id"""


# CRC-32 is spelled out bit by bit; 3988292384 is its reversed polynomial.
ORACLES["op11_prefix_trie"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY pos) AS seq FROM t GROUP BY conv_id),
h AS (SELECT conv_id, seq, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT) % 9 AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(m.seq[1:h.h], []), h.seq[h.h + 1:]) AS seq FROM h LEFT JOIN own m ON m.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS k FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM c)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
    (count(*) - 1) * coalesce(strlen(k[d].x), 0) AS own FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.k = node.k),
sub AS (SELECT k[1:a] AS k, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sub ON sub.k = f.k LEFT JOIN node up ON f.d > 0 AND up.k = f.k[1:f.d - 1]"""
