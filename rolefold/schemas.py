"""Declared schemas of the listing contract and the stored tables."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


CONTRACT_FIELDS = [
    "job_id_on_platform", "platform", "title", "company", "location", "url", "description",
    "salary", "date_posted", "skills", "salary_range", "remote_level", "skills_required",
]

RAW_LISTING = T.StructType(_strings(*CONTRACT_FIELDS))
LISTING_NORM = RAW_LISTING

LISTINGS = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + list(LISTING_NORM.fields)
    + [
        T.StructField("match_score", T.IntegerType()),
        *_strings("match_reasoning", "evaluation_details", "status"),
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        *_strings("platform_key"),
    ]
)

SCORES = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("match_score", T.IntegerType()),
    *_strings("match_reasoning", "evaluation_details"),
    T.StructField("scored_at", T.TimestampType()),
    T.StructField("call", T.LongType()),
    T.StructField("ordinal", T.LongType()),
    # The listing's platform: what refers to a listing is stored beside it, so that a purge finds it by its folder.
    *_strings("platform_key"),
])

# One append-only log: 'created', 'stage' and 'notes' events.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("application_id", T.LongType()),
    T.StructField("job_id", T.LongType()),
    *_strings("kind", "stage", "note", "notes", "interview_text", "follow_up_text",
              "resume_json", "resume_html"),
    T.StructField("created_at", T.TimestampType()),
    *_strings("platform_key"),
])

APPLICATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_id", T.LongType()),
    T.StructField("applied_date", T.TimestampType()),
    T.StructField("applied_at", T.TimestampType()),
    *_strings("resume_json", "resume_html", "status"),
    T.StructField("interview_date", T.TimestampType()),
    T.StructField("follow_up_date", T.TimestampType()),
    *_strings("notes", "history"),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

TIMELINE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("application_id", T.LongType()),
    *_strings("stage", "note"),
    T.StructField("created_at", T.TimestampType()),
])

EXPERIENCE = T.ArrayType(T.StructType([
    *_strings("company", "role", "dates", "location"),
    T.StructField("bullets", T.ArrayType(T.StringType())),
]))

RESUME = T.StructType([
    *_strings("resume_id", "name", "email", "phone", "summary"),
    T.StructField("experience", EXPERIENCE),
    T.StructField("skills", T.ArrayType(T.StringType())),
    *_strings("education"),
    T.StructField("certifications", T.ArrayType(T.StringType())),
])

RUN_METRICS = T.StructType([
    *_strings("run_id"),
    *[T.StructField(n, T.LongType()) for n in ("total_scraped", "newly_stored", "evaluated", "ready")],
    *_strings("status"),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("finished_at", T.TimestampType()),
])
