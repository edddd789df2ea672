"""JSON feed payloads → raw listings.

A payload row is ``(payload_id, body)`` with the response text as it was landed. A body that is
not an object gives no rows and one bad item does not affect its neighbours. Feeds that are landed item by
item come as rows ``(payload_id, pos, text)``; every reader here takes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.rows import settle
from ..functions.text import (
    blank_to_null, contains_any, html_to_text, last_segment, split_keywords, strip, title_slug,
)
from ..functions.values import (
    date_before_t, date_from_epoch, date_prefix, salary_in_dollars, salary_with_currency,
)

ANYWHERE = "Remote / Worldwide"
NESTED_SITE = "https://himalayas.app"  # fixed value: prefix of derived listing URLs


ENVELOPE = "jobs array<string>, __bad string"
ENVELOPE_OPTIONS = {"columnNameOfCorruptRecord": "__bad", "maxStringLen": str(2**31 - 1), "maxNestingDepth": "10000"}


def _envelopes(payloads: DataFrame) -> DataFrame:
    """The texts of each body's items; the body itself is never one JSON value in memory, so it may be of any size."""
    read = payloads.select("payload_id", "body", F.from_json("body", ENVELOPE, ENVELOPE_OPTIONS).alias("__read"))
    return read.select("payload_id", "body", F.when(F.col("__read.__bad").isNull(), F.col("__read.jobs")).alias("jobs"))


def _is_object() -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")), F.lit(False))


def item_texts(landed: DataFrame) -> DataFrame:
    """Rows ``payload_id, pos, text``, one per item; an unreadable body is one item without ``pos`` and text."""
    if "text" in landed.columns:
        return landed.select("payload_id", "pos", "text")
    items = _envelopes(landed).select("payload_id", F.col("jobs").isNull().alias("__whole"),
                                      F.posexplode(F.coalesce("jobs", F.array(F.lit(None).cast("string")))).alias("pos", "text"))
    return items.select("payload_id", F.when(~F.col("__whole"), F.col("pos")).alias("pos"), "text")


def _parsed_items(items: DataFrame) -> DataFrame:
    return items.withColumn("item", F.try_parse_json("text"))


def feed_items(payloads: DataFrame, defects: Observation | None = None) -> DataFrame:
    """One row per object among the items, in feed order.

    ``defects`` counts, while the rows are read, the items and bodies that are left out: its metric ``defective``.
    """
    parsed = _parsed_items(item_texts(payloads))
    if defects is not None:
        parsed = parsed.observe(defects, F.count_if(~_is_object()).alias("defective"))
    return parsed.filter(_is_object()).drop("text")


def feed_quarantine(payloads: DataFrame) -> DataFrame:
    """What ``feed_items`` leaves out: ``payload_id, pos, reason``, without ``pos`` for a whole body."""
    bad = _parsed_items(item_texts(payloads)).filter(~_is_object())
    reason = F.when(F.col("pos").isNull(), F.lit("no list of jobs can be read")).when(F.col("item").isNull(), F.lit("cannot be read")).otherwise(F.lit("not an object"))
    return bad.select("payload_id", "pos", reason.alias("reason"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", f"$.{path}", kind)


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("item", f"$.{path}", "variant"))


def _text(path: str) -> Column:
    return F.coalesce(_get(path), F.lit(""))


def _listing_columns(description_limit: int | None) -> list:
    description = F.col("description")
    if description_limit is not None:
        description = F.substring(description, 1, description_limit)
    return [
        "payload_id", "pos", "platform", "job_id_on_platform",
        strip(F.col("title")).alias("title"), strip(F.col("company")).alias("company"),
        strip(F.col("location")).alias("location"), description.alias("description"),
        strip(F.col("url")).alias("url"),
        F.col("salary").alias("salary_range"), "salary",
        F.lit("Fully Remote").alias("remote_level"),
        F.col("tags").alias("skills_required"), F.col("tags").alias("skills"),
        "date_posted",
    ]


def _mapped(payloads: DataFrame, columns: list[Column], defects: Observation | None) -> DataFrame:
    """Read the fields of every item once, whatever is filtered or derived from them later."""
    return feed_items(payloads, defects).select("payload_id", "pos", F.inline(F.array(F.struct(*columns))))


def _matching(mapped: DataFrame, fields: list[str], keywords) -> DataFrame:
    """Items in which any keyword occurs; each item's text is put together once."""
    if not split_keywords(keywords):
        return mapped
    hay = settle(mapped, {"__hay": F.lower(F.concat_ws(" ", *fields))})
    return hay.filter(contains_any(F.col("__hay"), keywords)).drop("__hay")


def nested_feed(
    payloads: DataFrame, keywords=None, platform: str = "Himalayas",
    description_limit: int | None = None, defects: Observation | None = None,
) -> DataFrame:
    """Feed with camel-case fields, category and location lists and epoch dates."""
    title, slug = _text("title"), blank_to_null(_get("companySlug"))
    derived = F.when(slug.isNotNull(), F.concat(
        F.lit(f"{NESTED_SITE}/companies/"), slug, F.lit("/jobs/"), title_slug(title)))
    places = _get("locationRestrictions", "array<string>")
    guid = blank_to_null(strip(_get("guid")))
    numeric_date = _kind("pubDate").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    mapped = _mapped(payloads, [
        F.lit(platform).alias("platform"),
        last_segment(guid).alias("job_id_on_platform"),
        title.alias("title"), _text("companyName").alias("company"),
        html_to_text(_get("description")).alias("description"),
        F.coalesce(blank_to_null(_get("applicationLink")), derived, F.lit("")).alias("url"),
        salary_with_currency(_get("minSalary", "double"), _get("maxSalary", "double"), _get("currency"))
        .alias("salary"),
        F.coalesce(F.array_join(F.transform(
            _get("categories", "array<string>"), lambda c: F.replace(c, F.lit("-"), F.lit(" "))), ", "),
            F.lit("")).alias("tags"),
        F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise(F.lit(ANYWHERE)).alias("location"),
        F.when(numeric_date, date_from_epoch(_get("pubDate", "double")))
        .otherwise(date_prefix(_get("pubDate"))).alias("date_posted"),
    ], defects)
    return _matching(mapped, ["title", "company", "description", "tags"], keywords).select(*_listing_columns(description_limit))


def flat_feed(
    payloads: DataFrame, keywords=None, platform: str = "Remotive",
    description_limit: int | None = None, defects: Observation | None = None,
) -> DataFrame:
    """Feed with snake-case fields, a tag list and ISO dates."""
    number = _get("id")
    tags = F.when(F.startswith(_kind("tags"), F.lit("ARRAY")), F.array_join(_get("tags", "array<string>"), ", "))
    mapped = _mapped(payloads, [
        F.lit(platform).alias("platform"),
        F.when(~number.isin("", "0"), number).alias("job_id_on_platform"),
        _text("title").alias("title"), _text("company_name").alias("company"),
        _text("category").alias("category"),
        html_to_text(_get("description")).alias("description"),
        _text("url").alias("url"),
        salary_in_dollars(_get("salary"), _get("salary_min", "double"), _get("salary_max", "double"))
        .alias("salary"),
        F.coalesce(tags, _text("tags")).alias("tags"),
        F.coalesce(blank_to_null(_get("candidate_required_location")), F.lit(ANYWHERE)).alias("location"),
        date_before_t(_get("publication_date")).alias("date_posted"),
    ], defects)
    return _matching(mapped, ["title", "company", "tags", "category", "description"], keywords).select(*_listing_columns(description_limit))
