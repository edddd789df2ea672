"""Queues, boards, lifecycle, storage and whole runs on the shared tables.

Documents are listings and labels are applications to them; orders are applications to customers;
events are a lifecycle log with one application per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stages import job_status, next_stage
from ..functions.values import tolerant_timestamp
from ..operators import filters
from ..operators.lifecycle import (
    audit_trail as trail, created_events, current_state as fold, history_entries as entries_of, history_json as as_json,
    notes_events,
)
from ..operators.ordering import with_position
from ..operators.purge import is_deprecated, orphans, purge_cascade as purge
from ..plans import board as boards, queues
from ..plans.campaign import run_campaign
from ..plans.store import ListingStore
from ..plans.tracker import Tracker
from ..session import materialise, run_dir
from ..sources.feeds import NESTED_SITE
from ..streaming.ingest import append_events, live_board, stream_files
from .collecting import _CARD_TITLE, _TEXT_ONE_LINE
from .matching import PROSE_LEXICON
from .registry import query, s_fold, s_skills, s_strip, table

_LISTINGS = f"""(SELECT doc_id AS id, source AS platform, {_CARD_TITLE} AS title, lang AS company, text AS description, source || ' ' || lang AS skills,
    CASE WHEN n_chars % 3 <> 0 THEN CAST(n_chars % 101 AS INTEGER) END AS match_score,
    CASE WHEN n_chars % 3 <> 0 THEN 'evaluated' ELSE 'scraped' END AS status,
    CASE WHEN doc_id % 10 <> 9 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 50 AS INTEGER)) END AS scraped_at,
    TIMESTAMP '2024-01-02 00:00:00' AS created_at FROM documents)"""
_APPS = "(SELECT doc_id AS id, doc_id AS job_id, CASE WHEN toxic = 1 THEN ' Ready' WHEN quality = 1 THEN 'Applied' END AS status FROM labels)"


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("n_chars"), F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        key.alias("id"), F.col("source").alias("platform"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("lang").alias("company"),
        F.col("text").alias("description"), F.concat_ws(" ", "source", "lang").alias("skills"),
        F.when(n % 3 != 0, (n % 101).cast("int")).alias("match_score"),
        F.when(n % 3 != 0, "evaluated").otherwise("scraped").alias("status"),
        F.when(key % 10 != 9, start + F.make_dt_interval(hours=(key % 50).cast("int"))).alias("scraped_at"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("created_at"))


def _label_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("job_id"),
        F.when(F.col("toxic") == 1, " Ready").when(F.col("quality") == 1, "Applied").alias("status"))


@query(f"""
SELECT id, platform, row_number() OVER (ORDER BY coalesce(scraped_at, created_at) DESC, id DESC) AS place
FROM {_LISTINGS} l WHERE status = 'scraped' AND match_score IS NULL
  AND NOT EXISTS (SELECT 1 FROM {_APPS} a WHERE a.job_id = l.id)""")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue with its order made visible as a place number."""
    waiting = queues.pending_queue(_listings(spark, sf_dir), _label_apps(spark, sf_dir), limit=None)
    placed = with_position(waiting.select("id", "platform", queues.recency().alias("at")), [F.col("at").desc_nulls_last(), F.col("id").desc()])
    return placed.select("id", "platform", (F.col("pos") + 1).alias("place"))


@query(f"""
SELECT id, match_score FROM {_LISTINGS} l WHERE (status = 'evaluated' OR match_score IS NOT NULL) AND match_score >= 70
  AND NOT EXISTS (SELECT 1 FROM {_APPS} a WHERE a.job_id = l.id)
ORDER BY match_score DESC, coalesce(scraped_at, created_at) DESC, id DESC LIMIT 50""")
def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.candidate_queue(_listings(spark, sf_dir), _label_apps(spark, sf_dir), 70, 50).select("id", "match_score")


@query(f"""
SELECT l.id, a.id IS NOT NULL AND coalesce(lower({s_strip('a.status')}), '') NOT IN ('ready', 'ready to apply') AS is_applied
FROM {_LISTINGS} l LEFT JOIN {_APPS} a ON a.job_id = l.id""")
def applied_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.applied_flags(_listings(spark, sf_dir), _label_apps(spark, sf_dir)).select("id", "is_applied")


@query("SELECT count(*) AS n_listings, (SELECT count(*) FROM labels) AS n_applications FROM documents")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.totals(_listings(spark, sf_dir), _label_apps(spark, sf_dir))


@query(f"""
SELECT id, platform FROM {_LISTINGS} WHERE match_score IS NOT NULL AND (contains(lower(title), 'rest') OR
  contains(lower(company), 'rest') OR contains(lower(description), 'rest') OR contains(lower(skills), 'rest'))""")
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.filter_listings(_listings(spark, sf_dir), " REST ", platforms=[], evaluated=True)
    return found.select("id", "platform")


_STATUS = """CASE WHEN o_orderstatus = 'F' THEN 'Rejected' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'Offer'
    WHEN '2-HIGH' THEN 'applied' WHEN '3-MEDIUM' THEN 'READY' WHEN '4-NOT SPECIFIED' THEN 'On hold' END END"""
_CANON = """CASE WHEN lower(status) = 'applied' THEN 'Applied' WHEN status IN ('Ready to Apply', 'Applied', 'Reply Received',
    'Interview Scheduled', 'Rejected', 'Offer') THEN status ELSE 'Ready to Apply' END"""
_ORDER_APPS = f"(SELECT o_orderkey AS app_id, o_custkey AS job_id, {_STATUS} AS status, o_orderdate AS updated_at FROM orders)"
_CUSTOMERS = """(SELECT c_custkey AS id, c_mktsegment AS platform, c_name AS title, 'Nation <' || c_nationkey || '> & "Co"' AS company,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS match_score,
    CASE WHEN c_custkey % 2 = 0 THEN 'https://h/' || c_custkey ELSE 'n/a' END AS url FROM customer)"""
_JOINED = f"(SELECT a.*, c.* EXCLUDE (id) FROM {_ORDER_APPS} a JOIN {_CUSTOMERS} c ON a.job_id = c.id)"


def _order_status():
    priority = F.col("o_orderpriority")
    return (F.when(F.col("o_orderstatus") == "F", "Rejected").when(priority == "1-URGENT", "Offer")
            .when(priority == "2-HIGH", "applied").when(priority == "3-MEDIUM", "READY")
            .when(priority == "4-NOT SPECIFIED", "On hold"))


def _order_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), _order_status().alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("platform"), F.col("c_name").alias("title"),
        F.concat(F.lit("Nation <"), F.col("c_nationkey").cast("string"), F.lit('> & "Co"')).alias("company"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("int")).alias("match_score"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://h/"), F.col("c_custkey").cast("string"))).otherwise("n/a")
        .alias("url"))


@query(f"""SELECT app_id, job_id, status AS app_status, strftime(updated_at, '%Y-%m-%d') AS updated, platform, match_score,
  row_number() OVER (ORDER BY updated_at DESC NULLS LAST, app_id DESC) AS place FROM {_JOINED}""")
def applications_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boards.applications_table(_order_apps(spark, sf_dir), _customers(spark, sf_dir))
    placed = with_position(rows, [F.coalesce("app_updated_at", "app_created_at").desc_nulls_last(), F.col("app_id").desc()])
    return placed.select("app_id", "job_id", "app_status", F.date_format("app_updated_at", "yyyy-MM-dd").alias("updated"),
                         "platform", "match_score", (F.col("pos") + 1).alias("place"))


@query(f"""SELECT app_id, job_id, match_score, row_number() OVER (ORDER BY match_score DESC NULLS LAST, updated_at DESC NULLS LAST, app_id DESC) AS place
FROM {_JOINED} WHERE lower(status) IN ('ready', 'ready to apply')""")
def ready_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boards.ready_list(_order_apps(spark, sf_dir), _customers(spark, sf_dir))
    placed = with_position(rows, [F.col("match_score").desc_nulls_last(), F.coalesce("app_updated_at", "app_created_at").desc_nulls_last(),
                                  F.col("app_id").desc()])
    return placed.select("app_id", "job_id", "match_score", (F.col("pos") + 1).alias("place"))


@query(f"""
SELECT app_id, match_score FROM {_JOINED} WHERE platform IN ('BUILDING', 'MACHINERY')
  AND coalesce(nullif(status, ''), 'Ready to Apply') IN ('Ready to Apply', 'Offer', 'applied') AND match_score >= 40
  AND (contains(lower(title), 'nation <1') OR contains(lower(company), 'nation <1'))""")
def filter_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = boards.applications_with_listings(_order_apps(spark, sf_dir), _customers(spark, sf_dir)).withColumns(
        {c: F.lit(None).cast("string") for c in ("skills", "notes", "match_reasoning")})
    kept = filters.filter_applications(
        apps, " Nation <1", ["BUILDING", "MACHINERY"], ["Ready to Apply", "Offer", "applied"], 40)
    return filters.sort_applications(kept, "Match Score (High to Low)").select("app_id", "match_score")


@query(f"""
SELECT app_id, title, replace(replace(replace(replace(company, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS company,
  platform, 'Remote' AS location, 'Not specified' AS salary, coalesce(status, 'Ready to Apply') AS stage,
  CASE WHEN match_score IS NULL THEN 'Unevaluated' WHEN match_score >= 80 THEN 'high' WHEN match_score >= 60 THEN 'mid' ELSE 'low' END AS band,
  coalesce('Match: ' || match_score || '%', 'Unevaluated') AS score_label,
  'Applied: ' || strftime(updated_at, '%Y-%m-%d') AS date_badge, CASE WHEN starts_with(url, 'http') THEN url END AS link FROM {_JOINED}""")
def display_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = boards.applications_with_listings(_order_apps(spark, sf_dir), _customers(spark, sf_dir)).withColumns({
        "location": F.lit(""), "salary_range": F.lit(None).cast("string"), "interview_date": F.lit(None).cast("timestamp"),
        "applied_at": F.col("app_created_at")})
    return boards.display_cards(apps)


@query(f"""
SELECT s.stage_no, s.stage, count(a.stage) AS n FROM (VALUES (0, 'Ready to Apply'), (1, 'Applied'), (2, 'Reply Received'),
  (3, 'Interview Scheduled'), (4, 'Rejected'), (5, 'Offer')) s(stage_no, stage)
LEFT JOIN (SELECT {_CANON} AS stage FROM {_ORDER_APPS}) a ON a.stage = s.stage GROUP BY 1, 2""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.stage_counts(spark, _order_apps(spark, sf_dir))


@query(f"""
SELECT app_id, stage, row_number() OVER (PARTITION BY stage ORDER BY updated_at DESC, app_id DESC) AS position
FROM (SELECT *, {_CANON} AS stage FROM {_JOINED})""")
def kanban_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = boards.board(_order_apps(spark, sf_dir), _customers(spark, sf_dir).select("id"))
    return cards.select("app_id", F.col("app_status").alias("stage"), "position")


@query(f"""
SELECT app_id, CASE WHEN status IN ('Ready to Apply', 'ready') THEN 'ready' ELSE lower(status) END AS job_status,
  CASE status WHEN 'Rejected' THEN 'Ready to Apply' WHEN 'Applied' THEN 'Reply Received' WHEN 'Offer' THEN 'Offer'
    WHEN 'Ready to Apply' THEN 'Applied' ELSE status END AS following FROM {_ORDER_APPS}""")
def stage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.col("status")
    return _order_apps(spark, sf_dir).select(
        F.col("id").alias("app_id"), job_status(stage).alias("job_status"), next_stage(stage).alias("following"))


@query(f"""
SELECT app_id, row_number() OVER (ORDER BY updated_at DESC, app_id DESC) AS newest,
  row_number() OVER (ORDER BY coalesce(match_score, 0) DESC, app_id DESC) AS by_score,
  row_number() OVER (ORDER BY lower(company), app_id DESC) AS by_company,
  row_number() OVER (ORDER BY lower(title), app_id DESC) AS by_title,
  row_number() OVER (ORDER BY coalesce(status, ''), app_id DESC) AS by_stage FROM {_JOINED}""")
def application_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every application under each of the five sort choices."""
    apps = boards.applications_with_listings(_order_apps(spark, sf_dir), _customers(spark, sf_dir)).select(
        "app_id", "app_updated_at", "app_created_at", "match_score", "company", "title", "app_status")
    for by, name in [("Newest First", "newest"), ("Match Score (High to Low)", "by_score"), ("Company (A-Z)", "by_company"),
                     ("Title (A-Z)", "by_title"), ("Stage", "by_stage")]:
        apps = with_position(apps, filters.application_order(by), "place").withColumn(name, F.col("place") + 1).drop("place")
    return apps.select("app_id", "newest", "by_score", "by_company", "by_title", "by_stage")


@query(f"""
SELECT id, row_number() OVER (ORDER BY coalesce(scraped_at, created_at) DESC, id DESC) AS place FROM {_LISTINGS}""")
def listings_by_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = _listings(spark, sf_dir).select("id", queues.recency().alias("at"))
    placed = with_position(newest, [F.col("at").desc_nulls_last(), F.col("id").desc()])
    return placed.select("id", (F.col("pos") + 1).alias("place"))


# -- lifecycle log ---------------------------------------------------------------------------

_LOG = """(SELECT event_id, user_id AS application_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'notes' ELSE 'stage' END AS kind,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'Applied' ELSE event_type END AS stage,
    CASE WHEN event_id % 3 = 0 THEN props ELSE '' END AS note, props AS notes,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN event_type = 'error' THEN 'soon' END AS interview_text, ts FROM events)"""
_MOVES = f"(SELECT * FROM {_LOG} WHERE kind <> 'notes')"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    is_note = kind == "error"
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("application_id"), F.col("user_id").alias("job_id"),
        F.when(kind == "signup", "created").when(is_note, "notes").otherwise("stage").alias("kind"),
        F.when(is_note, none).when(kind == "purchase", "Applied").otherwise(kind).alias("stage"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("").alias("note"), F.col("props").alias("notes"),
        F.when(is_note & (F.col("event_id") % 2 == 0), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(is_note, "soon")
        .alias("interview_text"), none.alias("follow_up_text"), none.alias("resume_json"), none.alias("resume_html"),
        F.col("ts").alias("created_at"))


def _micros(name: str):
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@query(f"""
SELECT application_id, (arg_max({{'v': stage}}, ts) FILTER (kind <> 'notes')).v AS status,
  (arg_max({{'v': notes}}, ts) FILTER (kind <> 'stage')).v AS notes,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS updated_at,
  strftime(min(ts) FILTER (kind = 'created'), '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
  strftime(arg_max(try_cast(interview_text AS TIMESTAMP), ts) FILTER (interview_text <> 'soon'), '%Y-%m-%d %H:%M:%S') AS interview
FROM {_LOG} GROUP BY application_id""")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fold(_log(spark, sf_dir))
    return state.select("application_id", "status", "notes", _micros("updated_at").alias("updated_at"),
                        _micros("created_at").alias("created_at"),
                        F.date_format("interview_date", "yyyy-MM-dd HH:mm:ss").alias("interview"))


@query(f"""
SELECT application_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first_applied_at FROM {_LOG}
WHERE stage = 'Applied' GROUP BY application_id""")
def first_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(_log(spark, sf_dir)).filter(F.col("first_applied_at").isNotNull()).select(
        "application_id", _micros("first_applied_at").alias("first_applied_at"))


_ENTRY = f"""SELECT application_id, event_id, row_number() OVER w AS seq, stage, lag(stage) OVER w AS previous_stage, ts,
    CASE WHEN note <> '' THEN note WHEN kind = 'created' THEN 'Application created' ELSE 'Stage transitioned to ' || stage END AS note
  FROM {_MOVES} WINDOW w AS (PARTITION BY application_id ORDER BY ts, event_id)"""


@query(f"""SELECT application_id, seq, stage, previous_stage, note FROM ({_ENTRY})""")
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(_log(spark, sf_dir)).select("application_id", "seq", "stage", "previous_stage", "note")


@query(f"""
SELECT application_id, CAST(floor((seq - 1) / 1000) AS BIGINT) AS chunk, count(*) AS n_entries, '[' || string_agg('{{"stage":"' || stage || '"' ||
    CASE WHEN previous_stage IS NULL THEN '' ELSE ',"previous_stage":"' || previous_stage || '"' END ||
    ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","note":"' || replace(note, '"', chr(92) || '"') || '"}}', ',' ORDER BY seq) || ']' AS history
FROM ({_ENTRY}) GROUP BY 1, 2""")
def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(entries_of(_log(spark, sf_dir)))


@query(f"""
WITH filled AS (SELECT *, last_value(CASE WHEN kind <> 'notes' THEN stage END IGNORE NULLS) OVER (
    PARTITION BY application_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS at_stage FROM {_LOG}),
traced AS (SELECT *, lag(at_stage) OVER (PARTITION BY application_id ORDER BY ts, event_id) AS before FROM filled)
SELECT event_id AS id, application_id, at_stage AS stage, CASE WHEN note <> '' THEN note WHEN kind = 'created' THEN 'Application initialized'
  ELSE 'Transitioned from ' || before || ' to ' || at_stage END AS note FROM traced""")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail(_log(spark, sf_dir)).select("id", "application_id", "stage", "note")


_DATE_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN 'tbd' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""
WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, {_DATE_TEXT} AS t,
  CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey || chr(10) || '[Recruiter: ' || o_orderpriority || ']'
       ELSE '[Recruiter: ' || o_orderpriority || ']' END AS notes FROM orders),
last_note AS (SELECT o_custkey, notes FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
last_date AS (SELECT o_custkey, t FROM o WHERE NOT starts_with(t, 'tbd')
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c.c_custkey AS application_id, n.notes, d.t AS interview, CASE WHEN n.notes IS NOT NULL THEN 1 END AS has_notes
FROM customer c LEFT JOIN last_note n ON n.o_custkey = c.c_custkey LEFT JOIN last_date d ON d.o_custkey = c.c_custkey""")
def notes_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applications, their orders as note updates; unparseable dates keep the last good one."""
    apps = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("event_id"), F.col("c_custkey").alias("application_id"), F.col("c_custkey").alias("job_id"))
    created = created_events(apps, F.lit("1900-01-01").cast("timestamp"))
    key = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(
        (key + 1_000_000_000).alias("event_id"), F.col("o_custkey").alias("application_id"),
        F.when(key % 2 == 0, F.concat(F.lit("n"), key.cast("string"))).otherwise("").alias("notes"),
        F.when(key % 7 == 0, F.concat(F.lit("tbd"), key.cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("interview_date"), F.lit("").alias("follow_up_date"), F.col("o_orderpriority").alias("recruiter_info"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    accepted, _unknown = notes_events(requests, created)
    return fold(created.unionByName(accepted)).select(
        "application_id", "notes", F.date_format("interview_date", "yyyy-MM-dd").alias("interview"),
        F.when(F.col("notes").isNotNull(), 1).alias("has_notes"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00') END AS parsed FROM orders""")
def tolerant_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(
        key % 3 == 1, F.date_format("o_orderdate", "yyyy")).otherwise("2026-13-45")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(tolerant_timestamp(text), "yyyy-MM-dd HH:mm").alias("parsed"))


@query("""
WITH gone AS (SELECT doc_id FROM documents WHERE lower(source) IN ('src3', 'src7')),
gone_apps AS (SELECT l.doc_id FROM labels l JOIN gone USING (doc_id))
SELECT 'listing' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'application', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'timeline', event_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM gone_apps)
UNION ALL SELECT 'removed', count(*) FROM gone""")
def purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("application_id"))
    kept = purge(_listings(spark, sf_dir), _label_apps(spark, sf_dir), timeline,
                 is_deprecated(F.upper("platform"), ["SRC3", "src7"]))

    def part(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"))

    return (part("listing", kept.listings).unionAll(part("application", kept.applications))
            .unionAll(part("timeline", kept.timeline))
            .unionAll(part("removed", kept.removed.agg(F.count(F.lit(1)).alias("id")))))


@query("SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("application_id"))
    return orphans(timeline, _label_apps(spark, sf_dir), "application_id").select("id")


# -- storage and whole runs ------------------------------------------------------------------

@query(f"""
WITH d AS (SELECT DISTINCT source, {_CARD_TITLE} AS title, substr(sha256(lower(source || ':' ||
    coalesce(nullif({_CARD_TITLE}, ''), 'Untitled Position') || ':' || lang || ':')), 1, 16) AS job_id,
    doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
k AS (SELECT source, job_id, bool_or(labelled) AS stored FROM d GROUP BY 1, 2),
old AS (SELECT source, job_id, row_number() OVER (ORDER BY source, job_id) AS id FROM k WHERE stored),
new AS (SELECT source, job_id, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY source, job_id) AS id FROM k WHERE NOT stored)
SELECT id, source AS platform_key, job_id AS job_id_on_platform, false AS is_new FROM old
UNION ALL SELECT id, source, job_id, true FROM new""")
def upsert_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are stored first; then all of them arrive."""
    store = ListingStore(spark, run_dir(spark, "upsert"))
    docs = table(spark, sf_dir, "documents", heavy=True)
    labels = table(spark, sf_dir, "labels").select("doc_id")

    def batch(df: DataFrame) -> DataFrame:
        return df.select(F.col("source").alias("platform"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                         F.col("lang").alias("company"), F.col("doc_id").alias("arrival"))

    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    store.upsert_listings(batch(docs.join(labels, "doc_id", "left_semi")), now)
    return store.upsert_listings(batch(docs), now)


_KEYED = f"""(SELECT source, substr(sha256(lower(source || ':untitled position:' || lang || ':' || doc_id)), 1, 16) AS job_id,
    doc_id, n_chars FROM documents)"""


def _stored_documents(spark: SparkSession, sf_dir: str) -> tuple[ListingStore, DataFrame]:
    """A store holding every document, and the listing id of each document."""
    store = ListingStore(spark, run_dir(spark, "documents"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("platform"), F.col("lang").alias("company"), F.col("doc_id").cast("string").alias("url"))
    store.upsert_listings(docs.drop("doc_id"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return store, store.read("listings").select("id", F.col("url").cast("bigint").alias("doc_id"))


@query(f"""
SELECT source AS platform_key, job_id AS job_id_on_platform, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 5
    ELSE quality * 100 END AS match_score, CASE WHEN l.doc_id IS NULL THEN 'scraped' ELSE 'evaluated' END AS status
FROM {_KEYED} d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores; toxic documents are scored a second time, and the later score counts."""
    store, ids = _stored_documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").join(ids, "doc_id").select(
        F.col("id").alias("job_id"), (F.col("quality") * 100).alias("match_score"), F.lit("label").alias("match_reasoning"), "toxic")
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    store.apply_scores(labels.drop("toxic"), now)
    store.apply_scores(labels.filter("toxic = 1").drop("toxic").withColumn("match_score", F.lit(5)), now + F.expr("interval 1 hour"))
    return store.listings().select("platform_key", "job_id_on_platform", "match_score", "status")


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'Rejected' WHEN quality = 1 THEN 'Applied' ELSE 'Ready to Apply' END AS status,
  'doc ' || doc_id AS notes, CAST(1 + CASE WHEN toxic = 1 OR quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_history FROM labels""")
def tracked_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application per labelled document, created twice to no effect, then moved on by its labels."""
    store, ids = _stored_documents(spark, sf_dir)
    tracker = Tracker(store)
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    jobs = table(spark, sf_dir, "labels").join(ids, "doc_id").select(
        F.col("id").alias("job_id"), "doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("notes"), "quality", "toxic")
    tracker.create(jobs.select("job_id", "notes"), now)
    made = tracker.create(jobs.select("job_id", F.lit("again").alias("notes")), now)
    stage = F.when(F.col("toxic") == 1, "Rejected").when(F.col("quality") == 1, "Applied")
    moves = jobs.join(made, "job_id").select("application_id", stage.alias("stage")).filter(F.col("stage").isNotNull())
    tracker.move(moves, now + F.expr("interval 1 day"))
    depth = tracker.history().groupBy("application_id").agg(F.max("seq").alias("n_history"))
    state = tracker.applications().select(F.col("id").alias("application_id"), "job_id", "status", "notes")
    return state.join(depth, "application_id").join(jobs.select("job_id", "doc_id"), "job_id").select(
        "doc_id", "status", "notes", "n_history")


@query("""
SELECT source AS platform_key, lang AS job_id_on_platform, coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'Untitled Position') AS title, text AS description
FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY (doc_id * 7919) % 10007, doc_id DESC) = 1""")
def upsert_first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole listings of which many share a key; the first to arrive stays, whatever it says."""
    store = ListingStore(spark, run_dir(spark, "arrivals"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("platform"), F.col("lang").alias("job_id_on_platform"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"), ((F.col("doc_id") * 7919) % 10007).alias("turn"), (-F.col("doc_id")).alias("within"))
    store.upsert_listings(rows, F.lit("2026-01-01 00:00:00").cast("timestamp"), ["turn", "within"])
    return store.read("listings").select("platform_key", "job_id_on_platform", "title", "description")


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'Rejected' WHEN quality = 1 THEN 'Applied' ELSE 'Ready to Apply' END AS status,
  CASE WHEN toxic = 1 THEN 5 ELSE quality * 100 END AS match_score FROM labels""")
def compacted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications and scores of labelled documents, of which some change after the store was compacted."""
    store, ids = _stored_documents(spark, sf_dir)
    tracker, now = Tracker(store), F.lit("2026-01-02 00:00:00").cast("timestamp")
    jobs = materialise(table(spark, sf_dir, "labels").join(ids, "doc_id").select(F.col("id").alias("job_id"), "doc_id", "quality", "toxic"), "labelled")
    made = tracker.create(jobs.select("job_id"), now)
    store.apply_scores(jobs.select("job_id", (F.col("quality") * 100).alias("match_score")), now)
    moves = jobs.join(made, "job_id")
    tracker.move(moves.where("quality = 1").select("application_id", F.lit("Applied").alias("stage")), now + F.expr("interval 1 day"))
    store.compact()
    tracker.move(moves.where("toxic = 1").select("application_id", F.lit("Rejected").alias("stage")), now + F.expr("interval 2 days"))
    store.apply_scores(jobs.where("toxic = 1").select("job_id", F.lit(5).alias("match_score")), now + F.expr("interval 2 days"))
    scored = store.listings().select(F.col("id").alias("job_id"), "match_score")
    return store.applications().select("job_id", "status").join(scored, "job_id").join(jobs.select("job_id", "doc_id"), "job_id").select(
        "doc_id", "status", "match_score")


@query("""
SELECT source AS platform, count(*) AS n, min(CASE WHEN source IN ('src3', 'src12') THEN 2 ELSE 1 END)::INTEGER AS least_visits
FROM documents GROUP BY source""")
def purged_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two platforms are purged and come back; the others' listings stay as they were."""
    store, _ = _stored_documents(spark, sf_dir)
    store.purge(["src3", "SRC12"])
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("platform"), F.col("lang").alias("company"), F.col("doc_id").cast("string").alias("url"))
    store.upsert_listings(docs, F.lit("2026-01-03 00:00:00").cast("timestamp"))
    visit = F.when(F.col("scraped_at") < F.lit("2026-01-02").cast("timestamp"), 1).otherwise(2)
    return store.read("listings").groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.min(visit).alias("least_visits"))


def _users_store(spark: SparkSession, sf_dir: str) -> tuple[Tracker, DataFrame]:
    """An application for each user, and the users' events with its id."""
    tracker = Tracker(ListingStore(spark, run_dir(spark, "users")))
    events = table(spark, sf_dir, "events")
    made = tracker.create(events.select(F.col("user_id").alias("job_id")).distinct(), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return tracker, events.withColumnRenamed("user_id", "job_id").join(made.select("job_id", "application_id"), "job_id")


@query("""
SELECT user_id AS job_id, coalesce(arg_max(event_type, event_id) FILTER (event_type <> 'error'), 'Ready to Apply') AS status,
  CAST(1 + count(*) FILTER (event_type <> 'error') AS BIGINT) AS n_history FROM events GROUP BY 1""")
def batched_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All moves of all applications as one table of requests; the last by ordinal counts."""
    tracker, events = _users_store(spark, sf_dir)
    moves = events.where("event_type <> 'error'").select("application_id", F.col("event_type").alias("stage"), F.col("event_id").alias("ordinal"))
    tracker.move(moves, F.lit("2026-01-02 00:00:00").cast("timestamp"))
    depth = tracker.history().groupBy("application_id").agg(F.max("seq").alias("n_history"))
    state = tracker.applications().select(F.col("id").alias("application_id"), "job_id", "status")
    return state.join(depth, "application_id").select("job_id", "status", "n_history")


@query("""SELECT user_id AS job_id, arg_max(props, (ts, event_id)) AS notes FROM events GROUP BY 1""")
def batched_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes as one table of requests, ordered by their own times, then by ordinal."""
    tracker, events = _users_store(spark, sf_dir)
    tracker.annotate(events.select("application_id", F.col("props").alias("notes"), F.col("ts").alias("created_at"), F.col("event_id").alias("ordinal")),
                     F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return tracker.applications().select("job_id", "notes")


@query(f"""
SELECT source AS platform_key, job_id AS job_id_on_platform, CAST(quality * 50 AS INTEGER) AS match_score,
  CASE WHEN l.doc_id % 3 = 0 THEN 'because ' || l.doc_id WHEN l.doc_id % 3 = 1 THEN '{{"quality":' || quality || '}}' ELSE 'plain ' || l.doc_id END AS match_reasoning
FROM {_KEYED} d JOIN labels l ON l.doc_id = d.doc_id""")
def score_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores whose details are objects, with and without a reasoning, or text; each is given twice in one call, and the later one counts."""
    store, ids = _stored_documents(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    details = (F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("because "), key).alias("reasoning"), "quality")))
               .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct("quality"))).otherwise(F.concat(F.lit("plain "), key)))
    scores = table(spark, sf_dir, "labels").join(ids, "doc_id").select(
        F.col("id").alias("job_id"), details.alias("evaluation_details"), "quality", F.explode(F.array(F.lit(2), F.lit(1))).alias("ordinal"))
    store.apply_scores(scores.withColumn("match_score", F.when(F.col("ordinal") == 2, F.col("quality") * 50).otherwise(100)).drop("quality"),
                       F.lit("2026-01-02 00:00:00").cast("timestamp"))
    return store.listings().where("status = 'evaluated'").select("platform_key", "job_id_on_platform", "match_score", "match_reasoning")


@query("""SELECT 0 AS n_before, count(*) AS n_after, min(1) AS first_id, count(*) AS last_id FROM documents""")
def reset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset leaves empty tables, and ids begin again."""
    store, _ = _stored_documents(spark, sf_dir)
    store.reset()
    before = store.read("listings").agg(F.count(F.lit(1)).cast("int").alias("n_before"))
    emptied = before.first()["n_before"]
    docs = table(spark, sf_dir, "documents").select(F.lit("p").alias("platform"), F.col("doc_id").cast("string").alias("job_id_on_platform"))
    store.upsert_listings(docs, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return store.read("listings").agg(F.lit(emptied).alias("n_before"), F.count(F.lit(1)).alias("n_after"), F.min("id").cast("int").alias("first_id"),
                                      F.max("id").alias("last_id"))


_RUN_RESUME = "The rest of la que."
_OFFERED = s_skills(s_fold(f"'{_RUN_RESUME}'"), PROSE_LEXICON)


_RUN_CTE = f"""
WITH k AS (SELECT DISTINCT ON (key) * FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 2 = 0 THEN 'item-' || doc_id ELSE
    substr(sha256(lower('himalayas:' || lang || ' role:' || source || ':https://host/' || doc_id)), 1, 16) END AS key,
    {_TEXT_ONE_LINE} AS body FROM documents)),
s AS (SELECT *, {s_skills('folded', PROSE_LEXICON)} AS required FROM (SELECT *, {s_fold('body')} AS folded FROM k)),
m AS (SELECT *, len(required) AS n, len(list_filter(required, lambda x: list_contains({_OFFERED}, x))) AS hit FROM s)"""


def _campaign(spark: SparkSession, sf_dir: str) -> tuple[ListingStore, DataFrame]:
    """A complete run over a landed feed, with a second source that fails."""
    docs, key = table(spark, sf_dir, "documents", heavy=True), F.col("doc_id")
    item = F.to_json(F.struct(
        F.concat("lang", F.lit(" Role")).alias("title"), F.col("source").alias("companyName"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"),
        F.concat(F.lit("https://host/"), key.cast("string")).alias("applicationLink"),
        F.when(key % 2 == 0, F.concat(F.lit(f"{NESTED_SITE}/item-"), key.cast("string"))).alias("guid")))
    payloads = docs.select(F.lpad(key.cast("string"), 20, "0").alias("payload_id"),
                           F.concat(F.lit('{"jobs":['), item, F.lit("]}")).alias("body"))
    store = ListingStore(spark, run_dir(spark, "campaign"))
    metrics = run_campaign(
        spark, store, {"Himalayas": payloads, "Remotive": docs}, F.lit("2026-01-01 00:00:00").cast("timestamp"),
        resume=spark.createDataFrame([(_RUN_RESUME,)], "raw_text string"), keywords="role", lexicon=PROSE_LEXICON)
    return store, metrics


@query(f"""{_RUN_CTE}
SELECT count(*) AS total_scraped, count(*) AS newly_stored, count(*) AS evaluated,
  count(*) FILTER (n > 0 AND floor(hit / n * 100) >= 70) AS ready, 'success' AS status, 1 AS n_errors FROM m""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = _campaign(spark, sf_dir)
    return metrics.select("total_scraped", "newly_stored", "evaluated", "ready", "status", F.size("errors").alias("n_errors"))


@query(f"""{_RUN_CTE},
r AS (SELECT key AS job_id_on_platform, 'Experienced professional seeking ' || lang || ' Role role at ' || source || '.' AS summary
  FROM m WHERE n > 0 AND floor(hit / n * 100) >= 70)
SELECT job_id_on_platform, 'Ready to Apply' AS status,
  '{{"name":"{_RUN_RESUME}","summary":"' || summary || '","experience":[],"skills":[],"education":"","certifications":[],"raw_text":"{_RUN_RESUME}"}}'
    AS resume_json, '<h1>{_RUN_RESUME}</h1>|<h2>Summary</h2><p>' || summary || '</p>' AS page FROM r""")
def campaign_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applications of a run: the text résumé, structured and tailored, and the headings of its page."""
    store, _ = _campaign(spark, sf_dir)
    listed = store.read("listings").select(F.col("id").alias("job_id"), "job_id_on_platform")
    page = F.array_join(F.regexp_extract_all("resume_html", F.lit("<h1>[^\n]*|<h2>[^\n]*"), F.lit(0)), "|")
    return store.applications().join(listed, "job_id").select("job_id_on_platform", "status", "resume_json", page.alias("page"))


@query("""
SELECT stage, count(*) AS n FROM (SELECT event_type AS stage FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY stage""")
def stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into the log; applications per current stage."""
    schema = table(spark, sf_dir, "events").schema
    target = run_dir(spark, "stream-board")
    stream = stream_files(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema).select("event_id", "ts", "user_id", "event_type")
    append_events(stream, f"{target}/log", f"{target}/progress")
    log = spark.read.schema(stream.schema).parquet(f"{target}/log")
    return live_board(log, "user_id", "event_type", ["ts", "event_id"])
