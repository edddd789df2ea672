"""One listing contract for every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rows import settle
from ..functions.text import blank_to_null, hash_key, strip
from ..functions.values import NOT_SPECIFIED
from ..schemas import CONTRACT_FIELDS


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("string")


def join_list(items: Column) -> Column:
    """Comma text of an array; empty items are left out, the others trimmed."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.transform(kept, strip), ", ")


def _skills(df: DataFrame, name: str) -> Column:
    """Falsy-to-null text of a skills field that may be an array or a scalar."""
    if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
        items = F.col(name).cast("array<string>")
        return F.when(F.size(items) > 0, join_list(items))
    return strip(blank_to_null(_text(df, name)))


def _required(value: Column, default: str) -> Column:
    """Falsy values take the default, and so does what is blank once stripped."""
    return F.coalesce(blank_to_null(strip(value)), F.lit(default))


def normalize_listings(
    df: DataFrame,
    default_platform: str = "Unknown",
    description_limit: int | None = None,
    company_first_key: bool = False,
) -> DataFrame:
    """Map raw listing columns onto the contract; other columns pass through.

    Missing columns count as null. ``company_first_key`` selects the other field order of the
    fallback key, the one used when a listing is stored without having been normalised.
    """
    # A blank platform is not replaced by the source's name, only a missing or empty one is.
    platform = _required(F.coalesce(blank_to_null(_text(df, "platform")), F.lit(default_platform)), "Unknown")
    title = _required(_text(df, "title"), "Untitled Position")
    company = _required(_text(df, "company"), "Unknown Company")
    url = strip(F.coalesce(_text(df, "url"), F.lit("")))
    description = strip(F.coalesce(_text(df, "description"), F.lit("")))
    if description_limit is not None:
        description = F.substring(description, 1, description_limit)
    location = strip(F.coalesce(
        blank_to_null(_text(df, "location")), blank_to_null(_text(df, "remote_level")), F.lit("Remote")))
    salary = F.coalesce(
        blank_to_null(strip(F.coalesce(blank_to_null(_text(df, "salary")), _text(df, "salary_range")))),
        F.lit(NOT_SPECIFIED))
    skills = F.coalesce(_skills(df, "skills"), _skills(df, "skills_required"), F.lit(""))

    others = [F.col(c) for c in df.columns if c not in CONTRACT_FIELDS]
    shaped = df.select(
        *others,
        strip(F.coalesce(_text(df, "job_id_on_platform"), F.lit(""))).alias("__id"),
        platform.alias("platform"), title.alias("title"), company.alias("company"),
        location.alias("location"), url.alias("url"), description.alias("description"),
        salary.alias("salary_range"), strip(_text(df, "date_posted")).alias("date_posted"),
        skills.alias("skills_required"),
    )
    order = ["platform", "company", "title", "url"] if company_first_key else ["platform", "title", "company", "url"]
    key = F.coalesce(blank_to_null(F.col("__id")), hash_key(*[F.col(c) for c in order]))
    return shaped.select(
        *[F.col(c) for c in df.columns if c not in CONTRACT_FIELDS],
        key.alias("job_id_on_platform"), "platform", "title", "company", "location", "url", "description",
        F.nullif(F.col("salary_range"), F.lit(NOT_SPECIFIED)).alias("salary"),
        "date_posted",
        blank_to_null(F.col("skills_required")).alias("skills"),
        "salary_range",
        F.col("location").alias("remote_level"),
        "skills_required",
    )


def raw_from_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Raw listing columns from JSON text, one object per row; anything but an object is dropped.

    Zero, false, empty lists and empty objects count as missing, as they do in the source data's
    own language. Other non-text values keep their JSON text.
    """
    parsed = settle(df, {"__v": F.try_parse_json(body)}).filter(
        F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")))

    def field(name: str) -> Column:
        value = F.try_variant_get("__v", f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        text = F.try_variant_get("__v", f"$.{name}", "string")
        if name in ("job_id_on_platform", "description", "date_posted"):
            return text  # only null is missing here
        falsy = (
            ((kind == "BOOLEAN") & (text == "false"))
            | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (text.try_cast("double") == 0))
            | text.isin("[]", "{}") & ~kind.isin("STRING")
        )
        return F.when(~F.coalesce(falsy, F.lit(False)), text)

    def skills(name: str) -> Column:
        value = F.try_variant_get("__v", f"$.{name}", "variant")
        items = F.try_variant_get("__v", f"$.{name}", "array<variant>")
        kept = F.filter(
            F.transform(items, lambda x: F.when(
                ~((F.schema_of_variant(x).rlike("^(BOOLEAN|BIGINT|DECIMAL|DOUBLE|FLOAT)")
                   & F.try_variant_get(x, "$", "string").rlike(r"^(false|-?0(\.0*)?)$"))),
                F.try_variant_get(x, "$", "string"))),
            lambda x: x.isNotNull())
        return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")),
                      blank_to_null(join_list(kept))).otherwise(field(name))

    columns = [
        (skills(c) if c in ("skills", "skills_required") else field(c)).alias(c) for c in CONTRACT_FIELDS
    ]
    return parsed.select(*[c for c in df.columns if c != body], *columns)


def quarantine_json(df: DataFrame, body: str = "body") -> DataFrame:
    """The rows ``raw_from_json`` leaves out, kept for inspection."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    return df.filter(~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))


def stored_form(df: DataFrame) -> DataFrame:
    """Columns as the listing table stores them: aliases completed, score cleaned, status set."""
    score = F.col("match_score").cast("int") if "match_score" in df.columns else F.lit(None).cast("int")
    extra = {
        "match_score": score,
        "match_reasoning": blank_to_null(_text(df, "match_reasoning")),
        "evaluation_details": _text(df, "evaluation_details"),
        "status": F.lit("scraped"),
        "date_posted": blank_to_null(F.col("date_posted")),
        "platform_key": F.lower(F.col("platform")),
    }
    return df.withColumns(extra)
