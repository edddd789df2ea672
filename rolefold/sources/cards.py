"""Page snapshots ``(page_id, url, html)`` → raw listings, one reader per portal layout.

Cards are cut out of the page text, exploded, and read field by field with fallbacks, all in
built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.entities import unescape
from ..functions.rows import settle
from ..functions.text import blank_to_null, strip, strip_tags, url_id
from ..functions.values import NOT_SPECIFIED
from ..operators.dedup import first_per_page
from .html import (
    attribute, balanced_inner, class_attr, inner, joined_text, open_tag, opening, pieces_from, raw_attribute,
    shown_lines, shown_text,
)

# Site prefixes for relative links.
SITE = {"Hirist": "https://www.hirist.tech", "Wellfound": "https://wellfound.com"}

# Containers of the full description on a detail page, in order of preference.
DETAIL_CONTAINERS = [
    ("div", "show-more-less-html__markup"),
    ("div", "description__text"),
    ("section", "show-more-less-html"),
]


def remote_level(location: Column, otherwise: Column) -> Column:
    return F.when(F.contains(F.lower(location), F.lit("remote")), F.lit("Fully Remote")).otherwise(otherwise)


def absolute(href: Column, site: str) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(site), href)).otherwise(href)


def without_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def usable_link(href: Column) -> Column:
    return (href != "") & ~F.contains(href, F.lit("/signup")) & ~F.contains(href, F.lit("/login"))


def detail_text(html: Column, containers=DETAIL_CONTAINERS, limit: int | None = None) -> Column:
    """Text of the first container present on a detail page."""
    fragment = F.coalesce(*[balanced_inner(html, tag, *([cls] if cls else [])) for tag, cls in containers])
    text = strip_tags(unescape(F.regexp_replace(fragment, "<[^>]+>", " ")))
    return F.substring(text, 1, limit) if limit is not None else text


def _keyword_text(keywords) -> str:
    return ", ".join([keywords] if isinstance(keywords, str) else keywords or [])


def _finish(df: DataFrame, portal: str, limit: int | None) -> DataFrame:
    description = F.substring("description", 1, limit) if limit is not None else F.col("description")
    return df.select(
        "page_id", "pos", F.lit(portal).alias("platform"), "job_id_on_platform", "title", "company", "location",
        "remote_level", "url", description.alias("description"), "salary", F.col("salary").alias("salary_range"),
        "date_posted", "skills", F.col("skills").alias("skills_required"))


def _read(
    pages: DataFrame, cards: Column, texts: dict[str, Column], attributes: dict[str, Column], as_text,
    lists: dict[str, Column] | None = None,
) -> DataFrame:
    """Cut out the cards and read the fields of each card once.

    All texts of a card go through one expression, and so do its attributes: decoding is a large
    expression, and one per field would make plans slow to analyse.
    """
    cut = pages.select("page_id", F.posexplode(cards).alias("pos", "card"))
    read = cut.select("page_id", "pos", F.inline(F.array(F.struct(
        F.transform(F.array(*texts.values()), as_text).alias("__texts"),
        F.transform(F.array(*attributes.values()), unescape).alias("__attributes"),
        *[F.filter(F.transform(c, as_text), lambda t: t != "").alias(n) for n, c in (lists or {}).items()]))))
    return read.select(
        "page_id", "pos", *(lists or {}),
        *[F.col("__texts")[i].alias(n) for i, n in enumerate(texts)],
        *[F.col("__attributes")[i].alias(n) for i, n in enumerate(attributes)])


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def guest_cards(
    pages: DataFrame, keywords=None, details: DataFrame | None = None, portal: str = "LinkedIn",
    description_limit: int | None = None,
) -> DataFrame:
    """List items, or base-card blocks on pages without list items.

    ``details`` may hold landed detail pages ``(url, html)``; their text replaces the template.
    """
    items = pieces_from(F.col("html"), r"<li\b", "li")
    blocks = pieces_from(F.col("html"), opening("div", "base-card"), "div")
    cards = F.when(F.size(items) > 0, items).otherwise(blocks)
    card = F.col("card")
    link = F.coalesce(open_tag(card, "a", "base-card__full-link"),
                      F.regexp_extract(card, r'(?is)<a\b[^>]*href\s*=\s*"[^"]*/jobs/view/[^"]*"[^>]*>', 0))
    rows = _read(pages, cards, {
        "title": F.coalesce(inner(card, "h3", "base-search-card__title"), inner(card, r"[a-z0-9]+", "base-card__title"), F.lit("")),
        "company": F.coalesce(
            inner(card, "h4", "base-search-card__subtitle"), inner(card, r"[a-z0-9]+", "base-card__subtitle"), F.lit("")),
        "location": inner(card, "span", "job-search-card__location"),
        "salary": inner(card, "span", "job-search-card__salary-info"),
        "when": inner(card, "time"),
    }, {"href": raw_attribute(link, "href"), "day": raw_attribute(open_tag(card, "time"), "datetime")}, joined_text).select(
        "page_id", "pos", "title", "company", without_query(F.col("href")).alias("url"), _or("location", "Remote"),
        _or("salary", NOT_SPECIFIED), F.coalesce(blank_to_null(F.col("day")), F.col("when")).alias("date_posted"),
    ).filter((F.col("title") != "") & (F.col("company") != "") & (F.col("url") != ""))
    if details is not None:
        landed = details.select("url", detail_text(F.col("html"), limit=description_limit).alias("detail"))
        rows = rows.join(landed.groupBy("url").agg(F.max("detail").alias("detail")), "url", "left")
    else:
        rows = rows.withColumn("detail", F.lit(None).cast("string"))
    template = F.format_string("%s at %s in %s. Remote opportunities available.", "title", "company", "location")
    return _finish(rows.withColumns({
        "job_id_on_platform": url_id(F.col("url"), portal),
        "remote_level": remote_level(F.col("location"), F.col("location")),
        "description": F.coalesce(blank_to_null(F.col("detail")), template),
        "skills": F.lit(_keyword_text(keywords)),
    }), portal, description_limit)


def tuple_cards(
    pages: DataFrame, keywords=None, portal: str = "Naukri", description_limit: int | None = None,
) -> DataFrame:
    """Cards with one element per field and a tag list."""
    starts = (rf"<div\b[^>]*{class_attr('srp-jobtuple-wrapper', 'cust-job-tuple', 'tuple')}"
              rf"|<article\b[^>]*{class_attr('jobTuple')}")
    card = F.col("card")

    tag_list = F.coalesce(inner(card, "ul", "tags-gt", "tag-li"), F.lit(""))
    list_items = F.regexp_extract_all(tag_list, F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))
    dotted = F.regexp_extract_all(card, F.lit(rf"(?is){opening('li', 'dot-gt')}(.*?)</li\s*>"), F.lit(1))
    rows = _read(pages, pieces_from(F.col("html"), starts, "div", "article"), {
        "title": inner(card, "a", "title"), "company": inner(card, "a", "comp-name", "subTitle"),
        "experience": inner(card, "span", "expwdth", "exp-wrap"),
        "salary": inner(card, "span", "sal-wrap", "ni-job-tuple-icon-srp-rupee"),
        "location": inner(card, "span", "loc-wrap", "locWdth"), "snippet": inner(card, "div|span", "job-desc", "row6"),
    }, {
        "url": raw_attribute(open_tag(card, "a", "title"), "href"),
        "own_id": raw_attribute(F.regexp_extract(card, r"(?is)^<[^>]*>", 0), "data-job-id"),
    }, shown_text, {"tag_items": F.when(F.size(list_items) > 0, list_items).otherwise(dotted)}).select(
        "page_id", "pos", _or("title", ""), _or("url", ""), _or("company", "Naukri Recruiter"), _or("experience", ""),
        _or("salary", NOT_SPECIFIED), _or("location", "India"), _or("snippet", ""), "own_id",
        F.array_join("tag_items", ", ").alias("tags"),
    ).filter((F.col("title") != "") & (F.col("url") != ""))
    template = F.format_string(
        "%s at %s.\nLocation: %s\nExperience: %s\nSalary: %s\nDescription: %s\nSkills: %s",
        "title", "company", "location", "experience", "salary", "snippet", "tags")
    return _finish(rows.withColumns({
        "job_id_on_platform": F.coalesce(blank_to_null(F.col("own_id")), url_id(F.col("url"), portal)),
        "remote_level": remote_level(F.col("location"), F.lit("On-site / Hybrid")),
        "description": template,
        "date_posted": F.lit(None).cast("string"),
        "skills": F.coalesce(blank_to_null(F.col("tags")), F.lit(_keyword_text(keywords))),
    }), portal, description_limit)


def split_heading(text: Column, company_default: str, title_default: str) -> tuple[Column, Column]:
    """``Company - Title`` or ``Company | Title``, split once; defaults otherwise."""
    def part(i: int) -> Column:
        return (
            F.when(F.contains(text, F.lit(" - ")), strip(F.get(F.split(text, " - ", 2), F.lit(i))))
            .when(F.contains(text, F.lit(" | ")), strip(F.get(F.split(text, r" \| ", 2), F.lit(i)))))

    return (F.coalesce(part(0), F.lit(company_default)),
            F.coalesce(part(1), blank_to_null(text), F.lit(title_default)))


def classify_span(text: Column) -> Column:
    """What a loose text fragment of a card means; the first rule that fits decides."""
    low = F.lower(text)

    def has(*parts: str) -> Column:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(low, F.lit(p))
        return test

    return (
        F.when(has("yr", "exp"), F.lit("experience"))
        .when(has("posted", "day", "ago"), F.lit("date"))
        .when(has("lpa", "inr", "$"), F.lit("salary"))
        .when((F.length(text) < 30) & ~has("save", "apply", "view"), F.lit("skill"))
    )


def link_cards(
    pages: DataFrame, keywords=None, portal: str = "Hirist", description_limit: int | None = None,
) -> DataFrame:
    """Cards that are one link each, with a heading, paragraphs and loose spans."""
    links = F.regexp_extract_all(
        F.col("html"), F.lit(r'(?is)(<a\b[^>]*href\s*=\s*"[^"]*/j/[^"]*"[^>]*>.*?)</a\s*>'), F.lit(1))
    card = F.col("card")

    def all_of(tag: str) -> Column:
        return F.regexp_extract_all(card, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))

    heading = F.regexp_extract(
        card, r'(?is)(?:<p\b[^>]*>|<([a-z0-9]+)\b[^>]*data-testid\s*=\s*"job_title"[^>]*>)(.*?)</(?:p|\1)\s*>', 2)
    rows = _read(
        pages, links, {"heading": heading}, {"href": raw_attribute(card, "href")}, shown_text,
        {"paragraphs": all_of("p"), "spans": all_of("span")}).filter(F.col("href") != "")

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: classify_span(s) == kind)

    def last_of(kind: str) -> Column:
        return F.try_element_at(of_kind(kind), F.lit(-1))

    company, title = split_heading(F.col("heading"), "Hirist Recruiter", "Software Engineer")
    rows = rows.select(
        "page_id", "pos",
        absolute(F.col("href"), SITE[portal]).alias("url"),
        url_id(F.col("href"), portal).alias("job_id_on_platform"),
        company.alias("company"), title.alias("title"),
        F.coalesce(F.get(F.filter("paragraphs", lambda p: p != F.col("heading")), F.lit(0)),
                   F.lit("India / Remote")).alias("location"),
        F.coalesce(last_of("experience"), F.lit(NOT_SPECIFIED)).alias("experience"),
        last_of("date").alias("date_posted"),
        F.coalesce(last_of("salary"), F.lit(NOT_SPECIFIED)).alias("salary"),
        F.coalesce(blank_to_null(F.array_join(F.array_distinct(of_kind("skill")), ", ")),
                   F.lit(_keyword_text(keywords))).alias("skills"),
    ).withColumn("remote_level", remote_level(F.col("location"), F.lit("On-site / Hybrid")))
    template = F.format_string(
        "Position: %s at %s.\nLocation: %s (%s).\nExperience required: %s.\nSalary: %s.\nKey skills: %s.",
        "title", "company", "location", "remote_level", "experience", "salary", "skills")
    return _finish(rows.withColumn("description", template), portal, description_limit)


def anchor_cards(
    pages: DataFrame, keywords=None, portal: str = "Wellfound", description_limit: int | None = None,
) -> DataFrame:
    """Listing links inside company blocks; company and salary come from the block's text."""
    block = r'<div\b[^>]*class\s*=\s*"[^"]*styles_result[^"]*"|<[a-z0-9]+\b[^>]*data-test\s*=\s*"StartupResult"'
    pieces = F.split(F.col("html"), f"(?is)(?={block})")
    anchor = r'(?is)(<a\b[^>]*href\s*=\s*"[^"]*/jobs/[^"]*"[^>]*>.*?)</a\s*>'
    piece = F.col("piece")
    # A piece begins with a block and may go on behind its end; what lies there has no company.
    inside = F.when(piece.rlike(f"(?is)^(?:{block})"), F.coalesce(
        F.when(piece.rlike(r"(?i)^<div\b"), balanced_inner(piece, "div")), piece))
    tag_length = F.length(F.regexp_extract(piece, "(?s)^<[^>]*>", 0))
    behind = F.when(inside.isNull(), piece).otherwise(
        F.substr(piece, F.when(piece.rlike(r"(?i)^<div\b"), tag_length).otherwise(0) + F.length(inside) + 1))
    sections = settle(
        pages.select("page_id", F.posexplode(pieces).alias("piece_no", "piece")),
        {"inside": inside, "behind": behind}, ["page_id", "piece_no"],
    ).select("page_id", "piece_no", F.posexplode(F.array("inside", "behind")).alias("part_no", "section"))
    anchors = (
        sections.filter(F.col("section").isNotNull())
        .withColumn("lines", F.when(F.col("part_no") == 0, shown_lines(F.col("section"))))
        .select("page_id", (F.col("piece_no") * 2 + F.col("part_no")).alias("section_no"), "lines",
                F.posexplode(F.regexp_extract_all("section", F.lit(anchor), F.lit(1))).alias("anchor_no", "card"))
        .withColumn("href", attribute(F.col("card"), "href"))
        .filter(usable_link(F.col("href")))
        .withColumn("url", absolute(F.col("href"), SITE[portal]))
    )
    # The first link to a URL decides, even when it is dropped for its text afterwards.
    first = first_per_page(anchors, "page_id", "url", ["section_no", "anchor_no"])
    salary = F.regexp_extract(F.array_join("lines", "\n"), r"(\$[0-9]+k?\s*[-\x{2013}\x{2014}]\s*\$[0-9]+k?)", 1)
    rows = settle(first, {"title": shown_text(F.col("card"))}).filter(
        (F.col("title") != "") & (F.length("title") <= 100)
    ).select(
        "page_id", (F.shiftleft(F.col("section_no").cast("bigint"), 32) + F.col("anchor_no")).alias("pos"),
        "url", "title", url_id(F.col("url"), portal).alias("job_id_on_platform"),
        F.coalesce(F.get("lines", F.lit(0)), F.lit("Startup Employer")).alias("company"),
        F.coalesce(blank_to_null(salary), F.lit(NOT_SPECIFIED)).alias("salary"),
        F.lit("Remote").alias("location"),
    )
    template = F.format_string(
        "%s at %s. Startup job opportunity on Wellfound. Location: %s. Compensation: %s.",
        "title", "company", "location", "salary")
    return _finish(rows.withColumns({
        "remote_level": remote_level(F.col("location"), F.lit("Hybrid / On-site")),
        "description": template,
        "date_posted": F.lit(None).cast("string"),
        "skills": F.lit(_keyword_text(keywords)),
    }), portal, description_limit)


