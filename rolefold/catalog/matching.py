"""Scoring, résumé parsing and tailoring on the shared tables.

Listings are the documents. The résumé is the whole benchmark table, one passage per row, or, where
pairs are wanted, each listing has one résumé assigned to it by an equality of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lexicon import SKILL_LEXICON, STOP_WORDS, with_skills
from ..functions.stages import score_band
from ..functions.text import distinct_tokens
from ..functions.values import nan_to_null, whole_number
from ..operators.coverage import (
    NO_KEYWORDS, NO_MATCHES, parse_replies, prompt_text, resume_profile, score_listings, score_pairs, skill_coverage,
    skill_score, token_coverage,
)
from ..operators.resume_text import (
    experience_entries, person_name, pick_section, sections, skill_items, structure_resumes,
)
from ..operators.lexicon_join import lexicon_join as join_lexicon
from ..operators.set_matching import best_listings
from ..operators.tailoring import STYLE, relevant_skills, render_resume, tailor, top_bullets as pick_bullets
from ..sources.resumes import json_resumes
from .registry import SPACE_RE, query, s_fold, s_list, s_pattern, s_skills, s_strip, s_tokens, table

# Words of the test prose stand in for skills, so that scores spread.
PROSE_LEXICON = [
    ("The", r"\bthe\b"), ("Of", r"\bof\b"), ("La", r"\bla\b"), ("Der", r"\bder\b"), ("Que", r"\bque\b"),
    ("REST", r"\brest(?:ful)?\b"), ("In The", r"\bin\s+the\b"), ("Les", r"\b(?:les|las)\b"),
]

_REQUIRED = s_skills("folded", PROSE_LEXICON)
_RESUME_SKILLS = ", ".join(
    f"CASE WHEN count(*) FILTER (regexp_matches({s_fold('text')}, '{s_pattern(p)}')) > 0 THEN '{n}' END"
    for n, p in PROSE_LEXICON)
_SKILLS_CTE = f"""
  resume AS (SELECT list_filter([{_RESUME_SKILLS}], lambda s: s IS NOT NULL) AS offered FROM benchmark),
  need AS (SELECT doc_id, text, {_REQUIRED} AS required FROM (SELECT doc_id, text, {s_fold('text')} AS folded FROM documents)),
  hits AS (SELECT doc_id, text, required, list_filter(required, lambda s: list_contains(offered, s)) AS matched
           FROM need, resume)"""
_SKILL_REASON = (
    "CASE WHEN len(matched) > 0 THEN 'Matched ' || len(matched) || '/' || len(required) || ' required skills. Found: ' || "
    "array_to_string(matched[1:8], ', ') ELSE 'Matched 0/' || len(required) || ' required skills (' || "
    "array_to_string(required[1:5], ', ') || ').' END")
_STOP = s_list(STOP_WORDS)
_TOKEN_CTE = f"""
  vocab AS (SELECT list_distinct(flatten(list({s_tokens('text')}))) AS words FROM benchmark),
  vmap AS (SELECT DISTINCT unnest(words) AS token FROM vocab),
  toks AS (SELECT doc_id, list_filter({s_tokens('text')}, lambda w: NOT list_contains({_STOP}, w)) AS tokens FROM documents),
  each AS (SELECT doc_id, unnest(tokens) AS token FROM toks),
  agg AS (SELECT e.doc_id, count(v.token) AS n, list(v.token ORDER BY v.token) FILTER (v.token IS NOT NULL) AS found
          FROM each e LEFT JOIN vmap v ON e.token = v.token GROUP BY e.doc_id),
  cover AS (SELECT t.doc_id, len(t.tokens) AS n_tokens, coalesce(a.n, 0) AS n_matched, a.found
            FROM toks t LEFT JOIN agg a ON a.doc_id = t.doc_id)"""
_TOKEN_SCORE = "CASE WHEN n_tokens = 0 THEN 0 ELSE CAST(floor(n_matched / n_tokens * 100) AS INTEGER) END"
_TOKEN_REASON = (
    f"CASE WHEN n_tokens = 0 THEN '{NO_KEYWORDS}' WHEN n_matched = 0 THEN '{NO_MATCHES}' "
    "ELSE 'Matched ' || n_matched || '/' || n_tokens || ' general keywords. Found: ' || "
    "array_to_string(found[1:8], ', ') END")
_BAND = ("CASE WHEN score IS NULL THEN 'Unevaluated' WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'mid' ELSE 'low' END")


@query(f"""
SELECT doc_id, array_to_string(skills, ', ') AS skills, len(skills) AS n FROM (
  SELECT doc_id, {s_skills('folded', SKILL_LEXICON)} AS skills FROM (SELECT doc_id, {s_fold('text')} AS folded FROM documents))""")
def skill_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_skills(table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text"), "text", "skills", SKILL_LEXICON)
    return found.select("doc_id", F.array_join("skills", ", ").alias("skills"), F.size("skills").cast("bigint").alias("n"))


@query(f"""
WITH {_SKILLS_CTE}
SELECT doc_id, len(matched) AS n_matched, len(required) AS n_required,
       CAST(floor(len(matched) / len(required) * 100) AS INTEGER) AS score, {_SKILL_REASON} AS reasoning
FROM hits WHERE len(required) > 0""")
def skill_coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = resume_profile(table(spark, sf_dir, "benchmark"), lexicon=PROSE_LEXICON)
    covered = skill_coverage(table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text"), "text", profile)
    score, reasoning = skill_score(F.col("required"), F.col("matched"))
    return covered.filter(F.size("required") > 0).select(
        "doc_id", F.size("matched").cast("bigint").alias("n_matched"), F.size("required").cast("bigint").alias("n_required"),
        score.alias("score"), reasoning.alias("reasoning"))


@query(f"""
WITH {_TOKEN_CTE}
SELECT doc_id, n_tokens, n_matched, {_TOKEN_SCORE} AS score, {_TOKEN_REASON} AS reasoning FROM cover""")
def token_coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = resume_profile(table(spark, sf_dir, "benchmark"), lexicon=PROSE_LEXICON)
    covered = token_coverage(table(spark, sf_dir, "documents", heavy=True), "doc_id", "text", profile)
    return covered.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                          F.col("n_matched").cast("bigint").alias("n_matched"), "score", "reasoning")


@query(f"""
WITH {_SKILLS_CTE}, {_TOKEN_CTE}
SELECT doc_id, score, reasoning, {_BAND} AS band FROM (
  SELECT h.doc_id,
    CASE WHEN {s_strip('text')} = '' THEN 0 WHEN len(required) > 0
         THEN CAST(floor(len(matched) / len(required) * 100) AS INTEGER) ELSE {_TOKEN_SCORE} END AS score,
    CASE WHEN {s_strip('text')} = '' THEN 'No content provided to evaluate.' WHEN len(required) > 0 THEN {_SKILL_REASON}
         ELSE {_TOKEN_REASON} END AS reasoning
  FROM hits h JOIN cover c ON h.doc_id = c.doc_id)""")
def score_router_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = resume_profile(table(spark, sf_dir, "benchmark"), lexicon=PROSE_LEXICON)
    return score_listings(table(spark, sf_dir, "documents", heavy=True), "doc_id", "text", profile)


def _s_marked(x: str) -> str:
    """Words with one blank around each, and a mark for whatever else parts them."""
    return rf"' ' || trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_{SPACE_RE[1:-1]}]+', ' ' || chr(1) || ' ', 'g'), '{SPACE_RE}+', ' ', 'g')) || ' '"


@query(f"""
WITH lexicon AS (SELECT 'item-' || item_id || '-' || n AS name, array_to_string(string_split(text, ' ')[1:n], ' ') AS form
  FROM benchmark, (SELECT unnest([1, 2, 3]) AS n)),
forms AS (SELECT name, {_s_marked(s_fold('form'))} AS form FROM lexicon),
texts AS (SELECT doc_id, {_s_marked(s_fold('text'))} AS body FROM documents)
SELECT doc_id, count(DISTINCT name) AS n, array_to_string(list_sort(list(DISTINCT name)), ' ') AS names
FROM texts JOIN forms ON contains(body, form) WHERE NOT contains(form, chr(1)) GROUP BY doc_id""")
def lexicon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon is a table: the first one, two and three words of every benchmark item."""
    words = F.split("text", " ")
    lexicon = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words"), F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("n")).select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("name"),
        F.array_join(F.slice("words", F.lit(1), F.col("n")), " ").alias("form"))
    found = join_lexicon(table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text"), lexicon, "doc_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))


_PAIR_SKILLS = s_skills("lf", SKILL_LEXICON)


@query(f"""
WITH n AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT d.doc_id AS listing_id, b.item_id AS resume_id, {s_fold('d.text')} AS lf, {s_fold('b.text')} AS rf,
        list_filter({s_tokens('d.text')}, lambda w: NOT list_contains({_STOP}, w)) AS lt, {s_tokens('b.text')} AS rt
      FROM documents d, n JOIN benchmark b ON d.doc_id % n.n = b.item_id),
q AS (SELECT listing_id, resume_id, {_PAIR_SKILLS} AS required, {s_skills('rf', SKILL_LEXICON)} AS offered,
        len(lt) AS n_tokens, list_filter(lt, lambda w: list_contains(rt, w)) AS found FROM p),
m AS (SELECT *, list_filter(required, lambda s: list_contains(offered, s)) AS matched, len(found) AS n_matched FROM q)
SELECT listing_id, resume_id,
  CASE WHEN len(required) > 0 THEN CAST(floor(len(matched) / len(required) * 100) AS INTEGER) ELSE {_TOKEN_SCORE} END AS score,
  CASE WHEN len(required) > 0 THEN {_SKILL_REASON} ELSE {_TOKEN_REASON} END AS reasoning FROM m""")
def assigned_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing scored against the one résumé assigned to it."""
    listings = table(spark, sf_dir, "documents", heavy=True).select(F.col("doc_id").alias("listing_id"), "text")
    resumes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("resume_id"), "text")
    how_many = resumes.agg(F.count(F.lit(1))).scalar()
    pairs = listings.select("listing_id", F.pmod("listing_id", how_many).alias("resume_id"))
    return score_pairs(pairs, listings, resumes)


def _s_terms(text: str, words: str) -> str:
    """Skills a text names, marked, and a list of its words."""
    return f"list_transform({s_skills(s_fold(text), SKILL_LEXICON)}, lambda s: '+' || s) AS skills, {words} AS words"


@query(f"""
WITH l AS (SELECT doc_id, CASE WHEN len(skills) > 0 THEN skills ELSE words END AS terms FROM (SELECT doc_id, {_s_terms(
    "text", f"list_filter({s_tokens('text')}, lambda w: NOT list_contains({_STOP}, w))")} FROM documents)),
r AS (SELECT conv_id, list_distinct(flatten(list(list_concat(skills, words)))) AS terms FROM (SELECT conv_id, {_s_terms(
    "text", s_tokens('text'))} FROM conversations) GROUP BY conv_id),
p AS (SELECT conv_id, doc_id, len(l.terms) AS n, len(list_intersect(l.terms, r.terms)) AS o FROM l, r WHERE len(l.terms) > 0),
s AS (SELECT *, CAST(floor(o / n * 100) AS INTEGER) AS score FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, o DESC, doc_id) AS rank FROM s WHERE score >= 30)
SELECT conv_id AS resume_id, CAST(rank AS INTEGER) AS rank, doc_id AS listing_id, score, CAST(o AS BIGINT) AS n_matched, CAST(n AS BIGINT) AS n_required
FROM b WHERE rank <= 10""")
def resume_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best listings of every conversation, read as a résumé, among all documents."""
    listings = table(spark, sf_dir, "documents", heavy=True).select(F.col("doc_id").alias("listing_id"), "text")
    resumes = table(spark, sf_dir, "conversations", heavy=True).select(F.col("conv_id").alias("resume_id"), "text")
    return best_listings(listings, resumes, min_score=30)


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(0, least(100, k * 2 - 20)) WHEN 1 THEN least(100, k)
         WHEN 2 THEN -1 ELSE 0 END AS score,
       CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN 'fallback' ELSE 'none' END AS reasoning
FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""")
def reply_parse_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer replies built from the event properties: too large, quoted, broken, without a score."""
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 4
    reply = (
        F.when(n == 0, F.concat(F.lit('Sure:\n{"score": '), (k * 2 - 20).cast("string"), F.lit('.7, "reasoning": "'),
                                "event_type", F.lit('"} done')))
        .when(n == 1, F.concat(F.lit('```{"score": "'), k.cast("string"), F.lit('"}```')))
        .when(n == 2, F.concat(F.lit('{"score": "'), k.cast("string"), F.lit(' of 100"}')))
        .otherwise(F.lit('{"reasoning": "none"}')))
    # A decimal like -0.3 is cut towards zero, as the oracle's whole numbers are.
    reply = F.when((n == 0) & (k * 2 - 20 < 0), F.replace(reply, F.lit(".7"), F.lit(".0"))).otherwise(reply)
    parsed = parse_replies(table(spark, sf_dir, "events").withColumn("reply", reply), "reply", F.lit(-1), F.lit("fallback"))
    return parsed.select("event_id", "score", "reasoning")


@query("""
SELECT doc_id, item_id, 'Rate.' || chr(10) || chr(10) || 'Listing:' || chr(10) || d.text || chr(10) || chr(10) ||
       'Résumé:' || chr(10) || b.text AS prompt
FROM documents d, (SELECT count(*) AS n FROM benchmark) c JOIN benchmark b ON d.doc_id % c.n = b.item_id""")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    resumes = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "resume")
    how_many = resumes.agg(F.count(F.lit(1))).scalar()
    listings = table(spark, sf_dir, "documents").withColumn("item_id", F.pmod("doc_id", how_many))
    return listings.join(resumes, "item_id").select(
        "doc_id", "item_id", prompt_text(F.col("text"), F.col("resume"), "Rate.").alias("prompt"))


# Lines that recur in many documents act as section headers.
PROSE_HEADERS = [
    "the and attion to thanedble the, anea. eriner thanea.", "and therhean is the is esndha reedes ha.", "of.", "les.",
    "and ornd.", "in in oredble ea.", "en laleenéelle la des et. enmentai. réleou eauoué.",
    "erreth was ofretihaou the that edouhe.", "nicht aulich für sch erüver enau sch der.",
    "licensed under the apache license, version 2.0.", "ascirr para osóciónta cióngañ no.",
]
_LINES = f"""
  lines AS (SELECT doc_id, i, {s_strip('l')} AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  marked AS (SELECT *, list_contains({s_list(PROSE_HEADERS)}, rtrim(lower(line), ':')) AS is_header FROM lines),
  numbered AS (SELECT *, sum(CAST(is_header AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS section_no,
    CASE WHEN is_header THEN rtrim(lower(line), ':') END AS header_name FROM marked),
  named AS (SELECT *, coalesce(max(header_name) OVER (PARTITION BY doc_id, section_no), 'header') AS name FROM numbered),
  bodies AS (SELECT doc_id, section_no, name, {s_strip("string_agg(line, chr(10) ORDER BY i)")} AS body
    FROM named WHERE NOT is_header GROUP BY doc_id, section_no, name),
  last_ones AS (SELECT doc_id, name, body FROM bodies
    QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY section_no DESC) = 1)"""


@query(f"WITH {_LINES} SELECT doc_id, name, body FROM last_ones")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", heavy=True).select(
        "doc_id", F.inline(sections(F.col("text"), PROSE_HEADERS)).alias("name", "body"))


_PICK = ["of.", "and ornd.", "les."]


@query(f"""
WITH {_LINES}
SELECT doc_id, coalesce({', '.join(f"max(nullif(body, '')) FILTER (name = '{n}')" for n in _PICK)}) AS body
FROM last_ones GROUP BY doc_id""")
def section_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents", heavy=True).select(
        "doc_id", F.map_from_entries(sections(F.col("text"), PROSE_HEADERS)).alias("s")).filter(F.size("s") > 0)
    return named.select("doc_id", pick_section(F.col("s"), _PICK).alias("body"))


_UPPER = "(upper(line) = line AND lower(line) <> line)"


@query(rf"""
WITH lines AS (SELECT doc_id, i, {s_strip('l')} AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  full_lines AS (SELECT *, {_UPPER} AS is_upper, contains(line, '|') AS has_pipe,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE line <> ''),
  stretches AS (SELECT *, sum(CASE WHEN k = 1 OR (is_upper AND length(line) > 5) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY k) AS stretch FROM full_lines),
  kinds AS (SELECT *, first_value(has_pipe) OVER (PARTITION BY doc_id, stretch ORDER BY k) AS piped,
    row_number() OVER (PARTITION BY doc_id, stretch ORDER BY k) AS pos,
    lag(i) OVER (PARTITION BY doc_id, stretch ORDER BY k) AS prev_i FROM stretches),
  heads AS (SELECT *, sum(CASE WHEN pos = 1 OR (piped AND has_pipe) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS entry,
    pos = 1 OR (piped AND has_pipe) AS is_head, NOT piped AND pos = 2 AND i = prev_i + 1 AND NOT is_upper AS is_role FROM kinds),
  cells AS (SELECT *, list_transform(string_split(line, '|'), lambda c: {s_strip('c')}) AS c,
    regexp_replace(line, '^[-•*·]+{SPACE_RE}*', '') AS bullet FROM heads)
SELECT doc_id, CAST(entry AS INTEGER) AS entry,
  max(CASE WHEN is_head THEN CASE WHEN piped THEN c[1] ELSE line END END) AS company,
  coalesce(max(CASE WHEN is_head AND piped THEN c[2] WHEN is_role THEN line END), '') AS role,
  coalesce(max(CASE WHEN is_head AND piped THEN c[3] END), '') AS dates,
  coalesce(max(CASE WHEN is_head AND piped THEN c[4] END), '') AS location,
  coalesce(string_agg(bullet, ' / ' ORDER BY k) FILTER (NOT is_head AND NOT is_role AND bullet <> ''), '') AS bullets
FROM cells GROUP BY doc_id, entry""")
def experience_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.posexplode(experience_entries(F.col("text"))).alias("n", "e"))
    return parsed.select(
        "doc_id", (F.col("n") + 1).alias("entry"), "e.company", "e.role", "e.dates", "e.location",
        F.array_join("e.bullets", " / ").alias("bullets"))


@query(rf"""
WITH lines AS (SELECT doc_id, {s_strip('l')} AS line, i FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  parts AS (SELECT doc_id, i, unnest(string_split_regex(regexp_replace(line, '^[-•*·]+{SPACE_RE}*', ''), '[,;|·]')) AS part,
    generate_subscripts(string_split_regex(regexp_replace(line, '^[-•*·]+{SPACE_RE}*', ''), '[,;|·]'), 1) AS j FROM lines WHERE line <> ''),
  kept AS (SELECT doc_id, i, j, {s_strip('part')} AS part FROM parts)
SELECT doc_id, count(*) AS n, string_agg(part, ' / ' ORDER BY i, j) AS items FROM kept
WHERE part <> '' AND length(part) < 50 GROUP BY doc_id""")
def skill_item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents", heavy=True).select("doc_id", skill_items(F.col("text")).alias("items"))
    return items.filter(F.size("items") > 0).select(
        "doc_id", F.size("items").cast("bigint").alias("n"), F.array_join("items", " / ").alias("items"))


_BODY = s_strip("text")


@query(rf"""
SELECT conv_id, turn,
  (list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_strip('l')}),
     lambda l: l <> '' AND length(l) < 60 AND NOT regexp_matches(l, '^.+@.+')))[1] AS first_line,
  nullif(regexp_extract(text || ' x' || turn || '@mail.example.org, more', '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+'), '') AS email,
  {_BODY} AS summary, role || ' / tooling' AS skills FROM conversations""")
def structured_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns laid out as plain-text résumés and read back."""
    turns = table(spark, sf_dir, "conversations", heavy=True).withColumn("layout", F.concat(
        "text", F.concat(F.lit(" x"), F.col("turn").cast("string"), F.lit("@mail.example.org, more")),
        F.lit("\nSummary:\n"), "text", F.lit("\n\nSKILLS\n• "), "role", F.lit(", ; tooling\n")))
    parsed = structure_resumes(turns, "layout")
    # The preamble's last line carries the address, so a name is only looked for in the text itself.
    return parsed.select("conv_id", "turn", person_name(F.col("text")).alias("first_line"), "email", "summary",
                         F.array_join("skills", " / ").alias("skills"))


@query(f"""
WITH scored AS (
  SELECT c.conv_id, c.turn, c.text, len(list_intersect({s_tokens('c.text')}, {s_tokens('d.text')})) AS overlap
  FROM conversations c JOIN documents d ON c.conv_id = d.doc_id)
SELECT conv_id AS resume_id, turn AS pos, text, CAST(overlap AS INTEGER) AS overlap, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS rank FROM scored) WHERE rank <= 5""")
def top_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as bullets, picked for the listing with the conversation's number."""
    bullets = table(spark, sf_dir, "conversations", heavy=True).select(
        F.col("conv_id").alias("resume_id"), F.col("turn").alias("pos"), "text")
    listings = table(spark, sf_dir, "documents", heavy=True).select(
        F.col("doc_id").alias("resume_id"), distinct_tokens(F.col("text")).alias("words"))
    return pick_bullets(bullets, listings, ["resume_id"])


_OFFER = s_list(["Rest API", "La", "thekla", "Qqq", "Der Plan"])


@query(f"""
WITH w AS (SELECT doc_id, lower(text) AS low, {s_tokens('text')} AS words FROM documents),
k AS (SELECT doc_id, list_filter({_OFFER}, lambda s: contains(low, lower(s)) OR
        len(list_filter(words, lambda w: contains(lower(s), w))) > 0) AS kept FROM w)
SELECT doc_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE {_OFFER} END, ', ') AS skills FROM k""")
def tailor_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = F.array(*[F.lit(s) for s in ["Rest API", "La", "thekla", "Qqq", "Der Plan"]])
    docs = table(spark, sf_dir, "documents", heavy=True).withColumn("words", distinct_tokens(F.col("text")))
    return docs.select("doc_id", F.array_join(
        relevant_skills(offer, F.col("text"), F.col("words")), ", ").alias("skills"))


def _resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A résumé per conversation turn: its lines are bullets, its role is an employer."""
    lines = F.split("text", "\n")
    job = F.struct(F.col("role").alias("company"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("role"),
                   F.lit("2024").alias("dates"), F.lit("").alias("location"), lines.alias("bullets"))
    return table(spark, sf_dir, "conversations", heavy=True).select(
        "conv_id", "turn", F.concat(F.lit("P & Q "), F.col("conv_id").cast("string")).alias("name"), F.lit("a@b.org").alias("email"),
        F.lit("555").alias("phone"), F.lit("").alias("summary"), F.array(job).alias("experience"),
        F.array(F.lit("C<D"), F.col("role")).alias("skills"), F.lit("").alias("education"))


def _s_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _s_page(bullets: str, summary: str, skills: str) -> str:
    items = (f"array_to_string(list_transform({bullets}, lambda b: '    <li>' || {_s_escape('b')} || '</li>' || chr(10)), '')")
    tags = f"array_to_string(list_transform({skills}, lambda s: '<span class=\"skill\">' || {_s_escape('s')} || '</span>'), '')"
    n = "chr(10)"
    name = "'P &amp; Q ' || conv_id"
    return (
        f"'<!DOCTYPE html>' || {n} || '<html lang=\"en\">' || {n} || '<head>' || {n} || '<meta charset=\"UTF-8\">' || {n} || "
        f"'<title>' || {name} || ' - Resume</title>' || {n} || '<style>{STYLE}</style>' || {n} || '</head>' || {n} || '<body>' || {n} || "
        f"'<h1>' || {name} || '</h1>' || {n} || '<div class=\"contact\">a@b.org · 555</div>' || {n} || {summary} || {n} || "
        f"'<h2>Experience</h2>' || {n} || '<div class=\"experience\">' || {n} || '  <h3>Turn ' || turn || ' at ' || role || '</h3>' || {n} || "
        f"'  <div class=\"meta\">2024</div>' || {n} || '  <ul>' || {n} || {items} || '  </ul>' || {n} || '</div>' || {n} || {n} || "
        f"'<h2>Skills</h2>' || {n} || '<div class=\"skills\">' || {tags} || '</div>' || {n} || {n} || '</body>' || {n} || '</html>'")


@query(f"""SELECT conv_id, turn, {_s_page("string_split(text, chr(10))", "''", "['C<D', role]")} AS html FROM conversations""")
def render_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resume_rows(spark, sf_dir)
    return rows.select("conv_id", "turn", render_resume(
        *[F.col(c) for c in ("name", "email", "phone", "summary", "experience", "skills", "education")]).alias("html"))


_BULLET_RANK = f"""
  b AS (SELECT conv_id, turn, role, d.text AS jd, d.source, unnest(string_split(c.text, chr(10))) AS line,
          generate_subscripts(string_split(c.text, chr(10)), 1) AS i FROM conversations c JOIN documents d ON c.conv_id = d.doc_id),
  o AS (SELECT *, len(list_intersect({s_tokens('line')}, {s_tokens('jd')})) AS overlap FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, i) AS rank FROM o),
  best AS (SELECT conv_id, turn, role, source, any_value(jd) AS jd, list(line ORDER BY rank) FILTER (rank <= 5) AS bullets
           FROM r GROUP BY conv_id, turn, role, source),
  fit AS (SELECT *, list_filter(['C<D', role], lambda s: contains(lower(jd), lower(s)) OR
            len(list_filter({s_tokens('jd')}, lambda w: contains(lower(s), w))) > 0) AS kept FROM best)"""
_SUMMARY = "'<h2>Summary</h2><p>Experienced professional seeking ' || role || ' role at ' || source || '.</p>'"


@query(f"""
WITH {_BULLET_RANK}
SELECT conv_id, turn, {_s_page("bullets", _SUMMARY, "CASE WHEN len(kept) > 0 THEN kept ELSE ['C<D', role] END")} AS html FROM fit""")
def tailored_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's résumé tailored to the listing numbered like its conversation, then rendered."""
    listings = table(spark, sf_dir, "documents", heavy=True).select(
        F.col("doc_id").alias("conv_id"), F.col("source").alias("employer"), F.col("text").alias("description"))
    rows = _resume_rows(spark, sf_dir).join(listings, "conv_id").withColumn("wanted", F.col("skills")[1])
    made = tailor(rows, "wanted", "employer", "description")
    return made.select("conv_id", "turn", render_resume(
        *[F.col(c) for c in ("name", "email", "phone", "summary", "experience", "skills", "education")]).alias("html"))


@query(f"""
SELECT c_custkey, CAST(trunc(c_acctbal / 100) AS INTEGER) AS score, {_BAND} AS band,
       CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS from_text FROM (
  SELECT *, CAST(trunc(c_acctbal / 100) AS INTEGER) AS score FROM customer)""")
def safe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and texts turned into whole scores; what does not parse is null."""
    score = whole_number(nan_to_null(F.col("c_acctbal") / 100))
    text = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_nationkey").cast("string")))
            .when(F.col("c_custkey") % 3 == 1, F.lit("88.5")).otherwise(F.lit("n/a")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", score.alias("score"), score_band(score).alias("band"), whole_number(text, "string").alias("from_text"))




@query("""
SELECT conv_id, turn, 'N' || conv_id AS name, role || ' / x' AS skills, 'Acme' AS company,
       array_to_string(string_split(text, chr(10)), ' / ') AS bullets FROM conversations WHERE turn % 3 <> 2
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL FROM conversations WHERE turn % 3 = 2""")
def json_resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumé objects in JSON, bare, wrapped or broken."""
    turn = F.col("turn")
    body = F.to_json(F.struct(
        F.concat(F.lit("N"), F.col("conv_id").cast("string")).alias("name"), F.array("role", F.lit("x")).alias("skills"),
        F.array(F.struct(F.lit("Acme").alias("company"), F.split("text", "\n").alias("bullets"))).alias("experience")))
    text = (F.when(turn % 3 == 0, body).when(turn % 3 == 1, F.concat(F.lit('{"format":"json","data":'), body, F.lit("}")))
            .otherwise(F.concat(F.lit("{"), body)))
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("resume_id"), text.alias("raw_text"))
    parsed = json_resumes(rows)
    job = F.get("experience", F.lit(0))
    return parsed.select("resume_id.conv_id", "resume_id.turn", "name", F.array_join("skills", " / ").alias("skills"),
                         job["company"].alias("company"), F.array_join(job["bullets"], " / ").alias("bullets"))
