"""Sources, normalisation, deduplication and text functions on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import (
    contains_any, html_escape, html_to_text, keyword_list, keyword_slug, last_segment, title_slug, url_id,
)
from ..functions.values import date_before_t, date_from_epoch, date_prefix, salary_in_dollars, salary_with_currency
from ..operators.dedup import first_per_page, first_wins, top_n
from ..operators.filters import distinct_platforms
from ..operators.normalize import normalize_listings, quarantine_json, raw_from_json
from ..sources.cards import (
    anchor_cards, detail_text, guest_cards, link_cards, tuple_cards, usable_link, without_query,
)
from ..sources.feeds import feed_quarantine as quarantined_feed, flat_feed, nested_feed
from ..sources.registry import collect_listings, read_item_lines
from ..sources.html import attribute, inner, joined_text, shown_text
from ..session import run_dir
from ..streaming.ingest import ingest_once, read_ingested, stream_files
from ..streaming.stateful import ingest_distinct
from .registry import query, s_collapse, s_html_text, s_strip, s_unescape, table

FIRST_LINE = "split_part(text, chr(10), 1)"


def _raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw listings without an id: source, first line, language, whole text."""
    return table(spark, sf_dir, "documents", heavy=True).select(
        "doc_id", F.col("source").alias("platform"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("lang").alias("remote_level"), F.col("text").alias("description"),
        F.when(F.col("n_chars") > 500, F.concat(F.col("n_chars").cast("string"), F.lit(" USD"))).alias("salary"),
        F.array(F.col("lang"), F.lit(None).cast("string"), F.lit(""), F.concat(F.lit(" "), F.col("source")))
        .alias("skills"))


_TITLE = f"coalesce(nullif({s_strip(FIRST_LINE)}, ''), 'Untitled Position')"


@query(f"""
SELECT doc_id, substr(sha256(lower(source || ':' || {_TITLE} || ':unknown company:')), 1, 16) AS job_id_on_platform,
       source AS platform, {_TITLE} AS title, 'Unknown Company' AS company, lang AS location, '' AS url,
       {s_strip('text')} AS description,
       CASE WHEN n_chars > 500 THEN n_chars || ' USD' END AS salary, CAST(NULL AS VARCHAR) AS date_posted,
       lang || ', ' || source AS skills,
       CASE WHEN n_chars > 500 THEN n_chars || ' USD' ELSE 'Not specified' END AS salary_range,
       lang AS remote_level, lang || ', ' || source AS skills_required
FROM documents""")
def normalize_listings_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_listings(_raw_documents(spark, sf_dir))


@query(f"""
WITH keyed AS (
  SELECT doc_id, lang, substr(sha256(lower(lang || ':' || coalesce(nullif({s_strip('text')}, ''), 'Untitled Position')
         || ':unknown company:')), 1, 16) AS job_id FROM documents)
SELECT lang AS platform, job_id AS job_id_on_platform, min(doc_id) AS doc_id FROM keyed GROUP BY lang, job_id""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("platform"), F.col("text").alias("title"))
    keyed = normalize_listings(raw).select("doc_id", "platform", "job_id_on_platform")
    return first_wins(keyed, ["doc_id"])


_KEYWORDS = "Rest, licensed ,, QUE des"
_MATCH = "(contains(hay, 'rest') OR contains(hay, 'licensed') OR contains(hay, 'que des'))"


@query(f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source, lower(source || ' ' || lang || ' ' || text) AS hay FROM documents) WHERE {_MATCH}""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return table(spark, sf_dir, "documents").filter(contains_any(hay, _KEYWORDS)).select("doc_id", "source")


@query(f"""
SELECT doc_id, source, rank FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM (
    SELECT doc_id, source, lower(source || ' ' || lang || ' ' || text) AS hay FROM documents) WHERE {_MATCH})
WHERE rank <= 5""")
def top_n_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(keyword_filter(spark, sf_dir), ["source"], ["doc_id"], 5, rank="rank")


@query("SELECT DISTINCT source AS platform FROM documents WHERE source <> ''")
def platform_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_platforms(table(spark, sf_dir, "documents").withColumnRenamed("source", "platform"))


@query(f"SELECT page_id, {s_html_text('html')} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", heavy=True).select("page_id", html_to_text(F.col("html")).alias("text"))


@query(rf"""
WITH links AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site,
         unnest(regexp_extract_all(html, '<a\s[^>]*>[^<]*</a>')) AS a,
         generate_subscripts(regexp_extract_all(html, '<a\s[^>]*>[^<]*</a>'), 1) - 1 AS pos FROM pages),
named AS (
  SELECT page_id, pos, {s_unescape("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, site,
         {s_collapse(s_unescape("regexp_replace(a, '<[^>]+>', ' ', 'g')"))} AS text FROM links),
kept AS (
  SELECT page_id, pos, text, split_part(CASE WHEN starts_with(href, '/') THEN site || href ELSE href END, '?', 1) AS url
  FROM named WHERE href <> '' AND NOT contains(href, '/signup') AND NOT contains(href, '/login'))
SELECT page_id, CAST(pos AS INTEGER) AS pos, url, text FROM kept
QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*>[^<]*</a>"), F.lit(0))
    links = table(spark, sf_dir, "pages", heavy=True).select(
        "page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site"),
        F.posexplode(anchors).alias("pos", "a")).withColumn("href", attribute(F.col("a"), "href"))
    full = F.when(F.startswith("href", F.lit("/")), F.concat("site", "href")).otherwise(F.col("href"))
    kept = links.filter(usable_link(F.col("href"))).select(
        "page_id", "pos", without_query(full).alias("url"), shown_text(F.col("a")).alias("text"))
    return first_per_page(kept, "page_id", "url", ["pos"])


_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
_PAGE_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


def _s_joined(x: str) -> str:
    piece = s_strip(s_unescape("p"))
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '<[^>]+>'), "
            f"lambda p: {piece}), lambda p: p <> ''), '')")


@query(f"""
SELECT page_id, coalesce(nullif({_s_joined(_H1)}, ''), {_s_joined(_PAGE_TITLE)}) AS heading FROM pages""")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    heading = F.coalesce(F.nullif(joined_text(inner(html, "h1")), F.lit("")), joined_text(inner(html, "title")))
    return table(spark, sf_dir, "pages").select("page_id", heading.alias("heading"))


_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, {s_html_text(_ARTICLE)} AS text FROM pages")
def page_detail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = [("div", "description__text"), ("article", None), ("body", None)]
    return table(spark, sf_dir, "pages", heavy=True).select(
        "page_id", detail_text(F.col("html"), containers, limit=None).alias("text"))


_BOUNDS = """SELECT p_partkey, p_name, p_brand,
    CASE WHEN p_partkey % 4 = 1 THEN 0 WHEN p_partkey % 4 = 3 THEN NULL ELSE p_retailprice * 100 END AS low,
    CASE WHEN p_partkey % 5 = 2 THEN 0 WHEN p_partkey % 5 = 4 THEN NULL ELSE p_size * 12345.5 END AS high FROM part"""


def _s_salary(prefix: str, again: str) -> str:
    low, high = "format('{:,}', CAST(floor(low) AS BIGINT))", "format('{:,}', CAST(floor(high) AS BIGINT))"
    return (f"CASE WHEN low <> 0 AND high <> 0 THEN {prefix} || {low} || ' - ' || {again} || {high} "
            f"WHEN low <> 0 THEN {prefix} || {low} || '+' WHEN high <> 0 THEN 'Up to ' || {prefix} || {high} "
            "ELSE 'Not specified' END")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand",
        F.when(key % 4 == 1, 0.0).when(key % 4 != 3, F.col("p_retailprice") * 100).alias("low"),
        F.when(key % 5 == 2, 0.0).when(key % 5 != 4, F.col("p_size") * F.lit(12345.5)).alias("high"))


@query(f"""
SELECT p_partkey, {_s_salary("cur || ' '", "''")} AS with_currency,
       CASE WHEN p_partkey % 7 = 0 THEN '$10k flat' ELSE {_s_salary("'$'", "'$'")} END AS in_dollars
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS cur FROM ({_BOUNDS}))""")
def salary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = F.when(F.col("p_partkey") % 3 == 0, "EUR").when(F.col("p_partkey") % 3 == 1, "")
    ready = F.when(F.col("p_partkey") % 7 == 0, " $10k flat ").otherwise("  ")
    return _bounds(spark, sf_dir).select(
        "p_partkey", salary_with_currency(F.col("low"), F.col("high"), currency).alias("with_currency"),
        salary_in_dollars(ready, F.col("low"), F.col("high")).alias("in_dollars"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_epoch, strftime(o_orderdate, '%Y-%m-%d') AS from_iso,
       strftime(o_orderdate, '%d.%m.%Y') AS from_text FROM orders""")
def date_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read as a wall-clock time without zone: format first, then parse in the session's zone (UTC).
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        date_from_epoch(F.unix_timestamp(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))).alias("from_epoch"),
        date_before_t(F.date_format(day, " yyyy-MM-dd'T'HH:mm:ss")).alias("from_iso"),
        date_prefix(F.date_format(day, "dd.MM.yyyy HH:mm")).alias("from_text"))


@query(rf"""
SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || ' / ' || p_brand || '!', '[^a-zA-Z0-9\s-]', '', 'g')),
         '[\s-]+', '-', 'g') || '-jobs' AS search_slug,
       trim(regexp_replace(lower('(' || p_name || ') ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS title_slug,
       p_brand AS guid_tail FROM part""")
def slug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        keyword_slug(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!")), "-jobs").alias("search_slug"),
        title_slug(F.concat(F.lit("("), "p_name", F.lit(") "), "p_type")).alias("title_slug"),
        last_segment(F.concat(F.lit("https://host/x/"), "p_brand", F.lit("//"))).alias("guid_tail"))


@query("""
SELECT o_orderkey, CAST(4000000000 + o_orderkey AS VARCHAR) AS view_id, CAST(7000000 + o_orderkey AS VARCHAR) AS tail_id,
       CAST(100000 + o_orderkey AS VARCHAR) AS six_id, CAST(NULL AS VARCHAR) AS short_id,
       CAST(50000 + o_orderkey AS VARCHAR) AS path_id FROM orders""")
def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")

    def url(head: str, base: int, tail: str = ""):
        return F.concat(F.lit(head), (key + base).cast("string"), F.lit(tail))

    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        url_id(url("https://h/jobs/view/staff-engineer-", 4_000_000_000, "?refId=1"), "LinkedIn").alias("view_id"),
        url_id(url("https://h/search/?id=12-", 7_000_000), "LinkedIn").alias("tail_id"),
        url_id(url("https://h/job-listings-dev-", 100_000, "?src=srp"), "Naukri").alias("six_id"),
        url_id(F.concat(F.lit("https://h/j/x-"), F.pmod(key, F.lit(9999)).cast("string")), "Hirist").alias("short_id"),
        url_id(url("https://h/jobs/", 50_000, "-lead"), "Wellfound").alias("path_id"))


@query(rf"""
SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' , ,' || p_brand || ',', ','), lambda k: trim(k)),
       lambda k: k <> '')[1] AS first_keyword, 2 AS n_keywords FROM part""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = keyword_list(F.concat("p_name", F.lit(" , ,"), "p_brand", F.lit(",")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.get(words, F.lit(0)).alias("first_keyword"), F.size(words).alias("n_keywords"))


_TEXT_ONE_LINE = s_html_text("'<p>' || text || '</p>'")


_NESTED_FIELDS = f"""'Himalayas' AS platform,
       CASE WHEN doc_id % 2 = 0 THEN 'item-' || doc_id END AS job_id_on_platform, lang || ' Role' AS title,
       source AS company, CASE WHEN doc_id % 3 = 0 THEN 'Remote / Worldwide' ELSE 'DE, ' || lang END AS location,
       {_TEXT_ONE_LINE} AS description,
       CASE WHEN doc_id % 2 = 0 THEN 'https://himalayas.app/companies/' || source || '/jobs/' || lang || '-role'
            ELSE 'https://host/' || doc_id END AS url,
       CASE WHEN doc_id % 4 = 0 THEN 'USD ' || format('{{:,}}', n_chars * 10) || '+'
            ELSE 'EUR ' || format('{{:,}}', n_chars * 10) || ' - ' || format('{{:,}}', n_chars * 20) END AS salary,
       'data work, ' || lang AS skills, strftime(to_timestamp(86400 * (doc_id + 1)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_posted
FROM documents"""


@query(f"SELECT doc_id AS payload_id, 2 AS pos, {_NESTED_FIELDS}")
def nested_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_feed(_nested_payloads(spark, sf_dir), description_limit=None).select(
        "payload_id", "pos", "platform", "job_id_on_platform", "title", "company", "location", "description", "url",
        "salary", "skills", "date_posted")


@query(f"SELECT {_NESTED_FIELDS}")
def nested_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed landed as lines of items, among which blank lines and lines that are no objects lie."""
    item = F.regexp_extract("body", r"(?s)^\{\"jobs\":\[\"x\",7,(.*),null\]\}$", 1)
    path = run_dir(spark, "item-lines")
    _nested_payloads(spark, sf_dir).select(F.explode(F.array(F.lit('"x"'), item, F.lit(""), F.lit("{broken"))).alias("value")).write.text(path)
    return nested_feed(read_item_lines(spark, path, "part-*")).select(
        "platform", "job_id_on_platform", "title", "company", "location", "description", "url", "salary", "skills", "date_posted")


@query("SELECT count(*) AS n_listings, 'Himalayas: ' || 3 * count(*) || ' items cannot be read' AS error FROM documents")
def collected_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of a feed with unreadable items, and the error that tells their number."""
    found, errors = collect_listings({"Himalayas": _nested_payloads(spark, sf_dir)}, spark, whole=True)
    return found.agg(F.count(F.lit(1)).alias("n_listings"), F.lit("; ".join(errors)).alias("error"))


def _nested_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per document, with items that are no objects around the real one."""
    key, docs = F.col("doc_id"), table(spark, sf_dir, "documents", heavy=True)
    item = F.to_json(F.struct(
        F.concat("lang", F.lit(" Role")).alias("title"), F.col("source").alias("companyName"),
        F.col("source").alias("companySlug"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"),
        F.when(key % 2 == 1, F.concat(F.lit("https://host/"), key.cast("string"))).alias("applicationLink"),
        F.when(key % 2 == 0, F.concat(F.lit("https://host/item-"), key.cast("string"), F.lit("/"))).alias("guid"),
        (F.col("n_chars") * 10).alias("minSalary"),
        F.when(key % 4 != 0, F.col("n_chars") * 20).otherwise(0).alias("maxSalary"),
        F.when(key % 4 != 0, F.lit("EUR")).alias("currency"),
        F.array(F.lit("data-work"), F.col("lang")).alias("categories"),
        F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("DE"), "lang"))
        .alias("locationRestrictions"),
        ((key + 1) * 86400).alias("pubDate")))
    return docs.select(key.alias("payload_id"), F.concat(
        F.lit('{"jobs":["x",7,'), item, F.lit(",null]}")).alias("body"))


@query("""
SELECT o_orderkey AS payload_id, 0 AS pos, 'Remotive' AS platform,
       CASE WHEN o_orderkey <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS job_id_on_platform,
       o_orderpriority AS title, 'C' || o_custkey AS company,
       CASE WHEN o_custkey % 2 = 0 THEN 'Remote / Worldwide' ELSE 'EU' END AS location, 'Ships & tracks' AS description,
       'https://host/' || o_orderkey AS url,
       CASE WHEN o_custkey % 3 = 0 THEN '$1k' ELSE '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '+' END AS salary,
       o_orderstatus || ', x' AS skills, strftime(o_orderdate, '%Y-%m-%d') AS date_posted
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def flat_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    item = F.to_json(F.struct(
        key.alias("id"), F.concat(F.lit("https://host/"), key.cast("string")).alias("url"),
        F.col("o_orderpriority").alias("title"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("company_name"),
        F.array("o_orderstatus", F.lit("x")).alias("tags"), F.lit("orders").alias("category"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("publication_date"),
        F.when(F.col("o_custkey") % 2 == 1, " EU ").alias("candidate_required_location"),
        F.when(F.col("o_custkey") % 3 == 0, " $1k ").alias("salary"), F.col("o_totalprice").alias("salary_min"),
        F.lit("<b>Ships</b> &amp; <i>tracks</i>").alias("description")))
    payloads = table(spark, sf_dir, "orders", heavy=True).select(
        key.alias("payload_id"), F.concat(F.lit('{"jobs":['), item, F.lit("]}")).alias("body"))
    kept = flat_feed(payloads, ["1-URGENT", "2-high", " 3-medium", "4-NOT"])
    return kept.select(
        "payload_id", "pos", "platform", "job_id_on_platform", "title", "company", "location", "description", "url",
        "salary", "skills", "date_posted")


def _first_line(docs: DataFrame) -> DataFrame:
    return docs.withColumn("line", F.split_part("text", F.lit("\n"), F.lit(1)))


_CARD_TITLE = s_strip(FIRST_LINE)


@query(f"""
SELECT doc_id AS page_id, 0 AS pos, CAST(4000000 + doc_id AS VARCHAR) AS job_id_on_platform, {_CARD_TITLE} AS title,
       source AS company, lang || ', Remote' AS location, 'Fully Remote' AS remote_level,
       'https://host/jobs/view/role-' || (4000000 + doc_id) AS url,
       {_CARD_TITLE} || ' at ' || source || ' in ' || lang || ', Remote. Remote opportunities available.' AS description,
       CASE WHEN doc_id % 2 = 0 THEN '$' || n_chars ELSE 'Not specified' END AS salary,
       CASE WHEN doc_id % 3 = 0 THEN '2026-08-29' ELSE '3 days ago' END AS date_posted, 'python, sql' AS skills
FROM documents WHERE {_CARD_TITLE} <> ''""")
def guest_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _first_line(table(spark, sf_dir, "documents", heavy=True))
    html = F.concat(
        F.lit('<ul class="results"><li class="x"><div class="base-card">\n<h3 class="a base-search-card__title">\n'),
        html_escape(F.col("line")), F.lit('</h3><h4 class="base-search-card__subtitle"><a href="#"> '), "source",
        F.lit(' </a></h4><span class="job-search-card__location">'), "lang",
        F.lit(', Remote</span><a class="base-card__full-link" href="https://host/jobs/view/role-'),
        (F.col("doc_id") + 4_000_000).cast("string"), F.lit('?trk=a&amp;b=c">Apply</a><time'),
        F.when(F.col("doc_id") % 3 == 0, ' datetime="2026-08-29"').otherwise(""), F.lit(">3 days ago</time>"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(
            F.lit('<span class="job-search-card__salary-info">$'), F.col("n_chars").cast("string"), F.lit("</span>")))
        .otherwise(""),
        F.lit('</div></li><li><div class="base-card"><h3 class="base-search-card__title">No company</h3></div></li></ul>'))
    pages = docs.select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return guest_cards(pages, ["python", "sql"], description_limit=None).drop("platform", "salary_range", "skills_required")


@query("""
SELECT p_partkey AS page_id, 0 AS pos,
       CASE WHEN p_partkey % 2 = 0 THEN 'D' || p_partkey ELSE CAST(1000000 + p_partkey AS VARCHAR) END AS job_id_on_platform,
       p_name AS title, p_brand AS company, CASE WHEN p_partkey % 5 = 0 THEN 'India' ELSE 'Remote, ' || p_type END AS location,
       CASE WHEN p_partkey % 5 = 0 THEN 'On-site / Hybrid' ELSE 'Fully Remote' END AS remote_level,
       'https://host/dev-' || (1000000 + p_partkey) || '?src=srp' AS url,
       p_name || ' at ' || p_brand || '.' || chr(10) || 'Location: ' ||
         CASE WHEN p_partkey % 5 = 0 THEN 'India' ELSE 'Remote, ' || p_type END || chr(10) || 'Experience: ' || p_size ||
         ' yrs' || chr(10) || 'Salary: Not specified' || chr(10) || 'Description: Makes ' || p_name || ' & more' || chr(10) ||
         'Skills: ' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || ', ' || p_size END AS description,
       'Not specified' AS salary, CAST(NULL AS VARCHAR) AS date_posted,
       CASE WHEN p_partkey % 7 = 0 THEN 'forge' ELSE p_type || ', ' || p_size END AS skills FROM part""")
def tuple_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    html = F.concat(
        F.lit('<section><div class="cust-job-tuple row"'),
        F.when(key % 2 == 0, F.concat(F.lit(' data-job-id="D'), key.cast("string"), F.lit('"'))).otherwise(""),
        F.lit('><a class="title " href="https://host/dev-'), (key + 1_000_000).cast("string"), F.lit('?src=srp"> '), "p_name",
        F.lit('</a><a class="subTitle">'), "p_brand", F.lit('</a><span class="expwdth">'), F.col("p_size").cast("string"),
        F.lit(" yrs</span>"),
        F.when(key % 5 != 0, F.concat(F.lit('<span class="locWdth"><i></i>Remote, '), "p_type", F.lit("</span>"))).otherwise(""),
        F.lit('<span class="job-desc">Makes <b>'), "p_name", F.lit("</b> &amp; more</span>"),
        F.when(key % 7 != 0, F.concat(
            F.lit('<ul class="tags-gt"><li>'), "p_type", F.lit("</li><li> </li><li>"), F.col("p_size").cast("string"),
            F.lit("</li></ul>"))).otherwise(""),
        F.lit('</div><div class="cust-job-tuple"><a class="title">No link</a></div></section>'))
    pages = table(spark, sf_dir, "part", heavy=True).select(key.alias("page_id"), html.alias("html"))
    return tuple_cards(pages, ["forge"]).drop("platform", "salary_range", "skills_required")


@query("""
WITH c AS (
  SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'India / Remote' ELSE c_mktsegment END AS location,
    CASE WHEN c_custkey % 3 = 2 THEN 'Hirist Recruiter' ELSE c_name END AS company,
    CASE c_custkey % 3 WHEN 2 THEN c_name WHEN 1 THEN 'Lead | ' || c_mktsegment ELSE 'Lead - ' || c_mktsegment END AS title,
    CASE WHEN c_custkey % 2 = 0 THEN 'Fully Remote' ELSE 'On-site / Hybrid' END AS remote_level,
    CASE WHEN c_custkey % 4 = 0 THEN 'go, sql' ELSE c_mktsegment || ', Rust' END AS skills FROM customer)
SELECT c_custkey AS page_id, 0 AS pos, CAST(10000 + c_custkey AS VARCHAR) AS job_id_on_platform, title, company, location,
       remote_level, 'https://www.hirist.tech/j/lead-' || (10000 + c_custkey) || '.html' AS url,
       'Position: ' || title || ' at ' || company || '.' || chr(10) || 'Location: ' || location || ' (' || remote_level ||
         ').' || chr(10) || 'Experience required: ' || c_nationkey || ' Yrs.' || chr(10) || 'Salary: 9 LPA.' || chr(10) ||
         'Key skills: ' || skills || '.' AS description,
       '9 LPA' AS salary, '2 days ago' AS date_posted, skills FROM c""")
def link_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_cards(_link_pages(spark, sf_dir), ["go", "sql"]).drop("platform", "salary_range", "skills_required")


def _link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    heading = (F.when(key % 3 == 0, F.concat("c_name", F.lit(" - Lead - "), "c_mktsegment"))
               .when(key % 3 == 1, F.concat("c_name", F.lit(" | Lead | "), "c_mktsegment")).otherwise(F.col("c_name")))
    html = F.concat(
        F.lit('<div><a class="c" href="/j/lead-'), (key + 10_000).cast("string"), F.lit('.html"><p>'), heading, F.lit("</p>"),
        F.when(key % 2 == 1, F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>"))).otherwise(""),
        F.lit("<span>1 yr</span><span>"), F.col("c_nationkey").cast("string"),
        F.lit(" Yrs</span><span>Posted today</span><span>2 days ago</span><span>9 LPA</span><span>Save</span>"),
        F.when(key % 4 != 0, F.concat(F.lit("<span>"), "c_mktsegment", F.lit("</span><span>Rust</span><span> Rust </span>")))
        .otherwise(""),
        F.lit("<span>A fragment that is much too long for a skill</span></a></div>"))
    return table(spark, sf_dir, "customer").select(key.alias("page_id"), html.alias("html"))


@query("""
SELECT s_suppkey AS page_id, job_id_on_platform, title, company, 'Remote' AS location, 'Fully Remote' AS remote_level,
       url, title || ' at ' || company || '. Startup job opportunity on Wellfound. Location: Remote. Compensation: ' ||
       salary || '.' AS description, salary, CAST(NULL AS VARCHAR) AS date_posted, 'ml' AS skills
FROM (
  SELECT s_suppkey, CAST(NULL AS VARCHAR) AS job_id_on_platform, 'Loose link' AS title, 'Startup Employer' AS company,
         'https://host/jobs/all' AS url, 'Not specified' AS salary FROM supplier
  UNION ALL
  SELECT s_suppkey, CAST(50000 + s_suppkey AS VARCHAR), 'Engineer ' || s_nationkey, s_name,
         'https://wellfound.com/jobs/' || (50000 + s_suppkey) || '-engineer',
         CASE WHEN s_suppkey % 2 = 0 THEN '$' || (100 + s_nationkey) || 'k – $200k' ELSE 'Not specified' END FROM supplier
  UNION ALL
  SELECT s_suppkey, '66666', 'Footer job', 'Startup Employer', 'https://wellfound.com/jobs/66666-x', 'Not specified' FROM supplier)""")
def anchor_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_cards(_anchor_pages(spark, sf_dir), ["ml"]).drop("platform", "salary_range", "skills_required", "pos")


def _anchor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    link = F.concat(F.lit('<a href="/jobs/'), (key + 50_000).cast("string"), F.lit('-engineer">'))
    html = F.concat(
        F.lit('<nav><a href="https://host/jobs/all">Loose link</a><a href="/jobs/signup">Join</a></nav>'),
        F.lit('<div class="styles_result__a"><h2>'), "s_name", F.lit("</h2><div>Hiring</div>"),
        link, F.lit("Engineer "), F.col("s_nationkey").cast("string"), F.lit("</a>"),
        F.when(key % 2 == 0, F.concat(F.lit("<p>$"), (F.col("s_nationkey") + 100).cast("string"), F.lit("k – $200k</p>"))).otherwise(""),
        link, F.lit("Again</a>"), F.lit('<a href="/jobs/7"></a></div><footer><div><a href="/jobs/66666-x">Footer job</a></div></footer>'))
    return table(spark, sf_dir, "supplier").select(key.alias("page_id"), html.alias("html"))


@query("""
SELECT doc_id, source AS platform, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE
         substr(sha256(lower(source || ':untitled position:' || lang || ':')), 1, 16) END AS job_id_on_platform,
       'Untitled Position' AS title, lang AS company, CASE WHEN doc_id % 2 = 0 THEN lang || ', 7, true' ELSE '' END AS skills_required
FROM documents""")
def raw_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw objects with numbers, booleans, nulls and empty containers where text is expected."""
    docs, key = table(spark, sf_dir, "documents", heavy=True), F.col("doc_id")
    item = F.concat(
        F.lit('{"platform":"'), "source", F.lit('","title":'), F.when(key % 3 == 0, "0").otherwise("false"),
        F.lit(',"company":" '), "lang", F.lit(' ","url":{},"job_id_on_platform":'),
        F.when(key % 2 == 0, key.cast("string")).otherwise("null"), F.lit(',"skills":'),
        F.when(key % 2 == 0, F.concat(F.lit('["'), "lang", F.lit('",null,0,7,"",false,true]'))).otherwise("[]"), F.lit("}"))
    bad = F.array(item, F.lit("[1,2]"), F.lit('"text"'), F.lit("{broken"), F.lit("null"))
    rows = docs.select("doc_id", F.explode(bad).alias("body"))
    return normalize_listings(raw_from_json(rows)).select(
        "doc_id", "platform", "job_id_on_platform", "title", "company", "skills_required")


@query("""
SELECT doc_id, CASE kind WHEN 0 THEN '[1,2]' WHEN 1 THEN '"' || lang || '"' WHEN 2 THEN '{broken' ELSE 'null' END AS body
FROM documents, (SELECT unnest([0, 1, 2, 3]) AS kind)""")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw reader leaves out."""
    docs = table(spark, sf_dir, "documents")
    bodies = F.array(F.lit("[1,2]"), F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("{broken"), F.lit("null"),
                     F.concat(F.lit('{"title":"'), "lang", F.lit('"}')))
    return quarantine_json(docs.select("doc_id", F.explode(bodies).alias("body")))


@query("""
SELECT doc_id AS payload_id, pos, CASE WHEN pos IS NULL THEN 'no list of jobs can be read' WHEN pos = 0 THEN 'not an object' ELSE 'cannot be read' END AS reason
FROM (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [0, 1] WHEN 3 THEN [] ELSE [NULL] END)::INTEGER AS pos FROM documents)""")
def feed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies and items that give no listing, each with its place and reason."""
    kind, item = F.col("doc_id") % 4, F.to_json(F.struct(F.col("text").alias("description")))
    body = (F.when(kind == 0, F.concat(F.lit('{"jobs":[1,"x",'), item, F.lit("]}"))).when(kind == 1, '{"jobs":5}')
            .when(kind == 2, F.concat(F.lit('{"jobs":['), item)).otherwise(F.concat(F.lit('{"jobs":['), item, F.lit("]}"))))
    return quarantined_feed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("payload_id"), body.alias("body")))


@query("""
SELECT 'Himalayas' AS platform, count(*) AS n, count(*) AS n_keys FROM documents
UNION ALL SELECT 'Hirist', count(*), count(*) FROM customer
UNION ALL SELECT 'Wellfound', count(*) + 2, count(*) + 2 FROM supplier""")
def collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources read, normalised, merged and deduplicated; repeated links collapse to one listing."""
    landed = {"Himalayas": _nested_payloads(spark, sf_dir), "Hirist": _link_pages(spark, sf_dir),
              "Wellfound": _anchor_pages(spark, sf_dir), "Remotive": _nested_payloads(spark, sf_dir)}
    # The errors that are left tell the unreadable items only: a source that fails is raised.
    found, _ = collect_listings(landed, spark, None, None, ["Himalayas", "Hirist", "Wellfound", "Unknown"], whole=True)
    return found.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("job_id_on_platform").alias("n_keys"))


@query("""SELECT sha256(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental ingest of the documents file; a text already stored is not stored again."""
    schema = table(spark, sf_dir, "documents").schema
    stream = stream_files(spark, f"{sf_dir.rstrip('/')}/documents.parquet", schema).select(
        F.sha2("text", 256).alias("text_key"), "doc_id")
    target = run_dir(spark, "stream-dedup")
    ingest_once(stream, ["text_key"], ["doc_id"], f"{target}/rows", f"{target}/progress")
    return read_ingested(spark, f"{target}/rows", stream.schema).select("text_key", "doc_id")


@query("SELECT DISTINCT sha256(text) AS text_key, source FROM documents")
def stream_dedup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents file as a stream whose known (text, source) keys are keyed state."""
    schema = table(spark, sf_dir, "documents").schema
    stream = stream_files(spark, f"{sf_dir.rstrip('/')}/documents.parquet", schema).select(F.sha2("text", 256).alias("text_key"), "source")
    target = run_dir(spark, "stream-state")
    ingest_distinct(stream, ["text_key", "source"], f"{target}/rows", f"{target}/progress")
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
