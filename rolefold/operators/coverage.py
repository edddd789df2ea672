"""Scoring listings against a résumé by skill lexicon and by token coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexicon import SKILL_LEXICON, STOP_WORDS, Lexicon, with_skills
from ..functions.stages import score_band
from ..functions.text import blank_to_null, distinct_tokens, strip
from ..functions.values import whole_number

NO_CONTENT = "No content provided to evaluate."
NO_KEYWORDS = "No recognizable skill keywords found in job description."
NO_MATCHES = "No direct keyword matches found in resume."


@dataclass
class ResumeProfile:
    """What scoring needs to know about a résumé: one row per skill and per token."""

    skills: DataFrame
    tokens: DataFrame
    text_present: DataFrame  # one row, one boolean
    lexicon: Lexicon

    def skill_list(self) -> Column:
        """The skills as a one-row subquery; never longer than the lexicon."""
        return F.coalesce(self.skills.agg(F.collect_set("skill")).scalar(), F.array().cast("array<string>"))

    def has_text(self) -> Column:
        return F.coalesce(self.text_present.scalar(), F.lit(False))


def resume_profile(passages: DataFrame, text: str = "text", lexicon: Lexicon = SKILL_LEXICON) -> ResumeProfile:
    """Profile of a résumé given as any number of text rows; each row is read on its own."""
    skills = with_skills(passages.select(text), text, "found", lexicon).select(F.explode("found").alias("skill"))
    words = passages.select(F.explode(distinct_tokens(F.col(text))).alias("token"))
    present = passages.agg(F.max(strip(F.col(text)) != ""))
    return ResumeProfile(skills.distinct(), words.distinct(), present, lexicon)


def share(matched: Column, total: Column) -> Column:
    """Whole percentage, cut, not rounded."""
    return F.floor(matched / total * 100).cast("int")


def skill_score(required: Column, matched: Column) -> tuple[Column, Column]:
    """Score and reasoning from the two skill arrays; for listings that name at least one skill."""
    n, total = F.size(matched), F.size(required)
    reasoning = F.when(
        n > 0,
        F.concat(F.format_string("Matched %d/%d required skills. Found: ", n, total),
                 F.array_join(F.slice(matched, 1, 8), ", ")),
    ).otherwise(F.concat(F.format_string("Matched 0/%d required skills (", total),
                         F.array_join(F.slice(required, 1, 5), ", "), F.lit(").")))
    return F.when(total > 0, share(n, total)), reasoning


def token_score(matched: Column, total: Column, found: Column) -> tuple[Column, Column]:
    """Score and reasoning of the fallback; ``found`` holds the matched tokens in order."""
    reasoning = (
        F.when(total == 0, F.lit(NO_KEYWORDS))
        .when(matched == 0, F.lit(NO_MATCHES))
        .otherwise(F.concat(F.format_string("Matched %d/%d general keywords. Found: ", matched, total),
                            F.array_join(F.slice(found, 1, 8), ", "))))
    return F.when(total == 0, F.lit(0)).otherwise(share(matched, total)), reasoning


def required_tokens(text: Column) -> Column:
    return F.array_except(distinct_tokens(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def skill_coverage(listings: DataFrame, text: str, profile: ResumeProfile) -> DataFrame:
    """Add ``required`` and ``matched`` skills; no shuffle, the résumé side is a literal."""
    found = with_skills(listings, text, "required", profile.lexicon)
    return found.withColumn("matched", F.array_intersect("required", profile.skill_list()))


def match_tokens(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """Reduce a token array column to ``n_matched`` and ``found`` (sorted), given a vocabulary of distinct tokens.

    A listing's tokens are distinct. Rows equal in all columns are counted together and come back as many as they were. A row without tokens gets one of its own that no vocabulary
    has, so such rows are spread like others. Spark chooses the join by the vocabulary's size, and splits a frequent token's rows where adaptive execution finds skew.
    """
    kept = [c for c in df.columns if c != tokens]
    own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    single = df.select(*kept, F.greatest(F.size(own), F.lit(1)).alias("__size"), F.md5(F.array_join(own, " ").cast("binary")).alias("__set"), own.alias("__own"))
    none = F.concat(F.lit(" "), F.xxhash64(*kept).cast("string"))
    exploded = single.select(*kept, "__size", "__set", F.explode(F.when(F.size("__own") > 0, F.col("__own")).otherwise(F.array(none))).alias("token"))
    joined = exploded.join(vocabulary.withColumn("hit", F.lit(True)), "token", "left")
    counted = joined.groupBy(*kept, "__size", "__set").agg(
        F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("token")))).alias("found"),
        F.floor(F.count(F.lit(1)) / F.col("__size")).cast("int").alias("__copies"))
    return counted.select(*kept, "found", F.size("found").alias("n_matched"), F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).drop("__copy")


def token_coverage(listings: DataFrame, key: str, text: str, profile: ResumeProfile) -> DataFrame:
    """Columns ``key, n_tokens, n_matched, found, score, reasoning`` of the token fallback alone."""
    listed = listings.select(key, required_tokens(F.col(text)).alias("__tokens"))
    listed = listed.withColumn("n_tokens", F.size("__tokens"))
    counted = match_tokens(listed, key, "__tokens", profile.tokens)
    score, reasoning = token_score(F.col("n_matched"), F.col("n_tokens"), F.col("found"))
    return counted.withColumns({"score": score, "reasoning": reasoning})


def score_listings(listings: DataFrame, key: str, text: str, profile: ResumeProfile) -> DataFrame:
    """Route every listing: blank text, skill coverage if it names a skill, else token coverage.

    Returns ``key, score, reasoning, band``.
    """
    blank = ~profile.has_text() | (strip(F.coalesce(F.col(text), F.lit(""))) == "")
    routed = skill_coverage(listings.select(key, text), text, profile)
    by_skill, skill_reason = skill_score(F.col("required"), F.col("matched"))
    direct = blank | (F.size("required") > 0)
    routed = routed.select(
        key,
        F.when(blank, F.lit(0)).otherwise(by_skill).alias("__score"),
        F.when(blank, F.lit(NO_CONTENT)).when(F.size("required") > 0, skill_reason).alias("__reason"),
        F.when(~direct, required_tokens(F.col(text))).alias("__tokens"),
    ).withColumn("n_tokens", F.when(F.col("__tokens").isNotNull(), F.size("__tokens")).otherwise(0))
    counted = match_tokens(routed, key, "__tokens", profile.tokens)
    score, reasoning = token_score(F.coalesce("n_matched", F.lit(0)), F.col("n_tokens"), F.col("found"))
    return counted.select(
        key, F.coalesce("__score", score).alias("score"), F.coalesce("__reason", reasoning).alias("reasoning"),
    ).withColumn("band", score_band(F.col("score")))


def score_pairs(
    pairs: DataFrame, listings: DataFrame, resumes: DataFrame, lexicon: Lexicon = SKILL_LEXICON,
) -> DataFrame:
    """Score given (listing_id, resume_id) pairs; both sides are prepared once, then equi-joined."""
    left = with_skills(listings.select("listing_id", "text"), "text", "required", lexicon).select(
        "listing_id", "required", (strip(F.col("text")) == "").alias("l_blank"),
        F.when(F.size("required") == 0, required_tokens(F.col("text"))).alias("l_tokens"))
    right = with_skills(resumes.select("resume_id", "text"), "text", "offered", lexicon).select(
        "resume_id", "offered", (strip(F.col("text")) == "").alias("r_blank"),
        distinct_tokens(F.col("text")).alias("r_tokens"))
    both = pairs.join(left, "listing_id").join(right, "resume_id").withColumns({
        "matched": F.array_intersect("required", "offered"),
        "found": F.sort_array(F.array_intersect("l_tokens", "r_tokens")),
    })
    by_skill, skill_reason = skill_score(F.col("required"), F.col("matched"))
    by_token, token_reason = token_score(F.size("found"), F.size("l_tokens"), F.col("found"))
    blank, named = F.col("l_blank") | F.col("r_blank"), F.size("required") > 0
    return both.select(
        "listing_id", "resume_id",
        F.when(blank, 0).when(named, by_skill).otherwise(by_token).alias("score"),
        F.when(blank, F.lit(NO_CONTENT)).when(named, skill_reason).otherwise(token_reason).alias("reasoning"),
    )


def parse_replies(df: DataFrame, reply: str, fallback_score: Column, fallback_reason: Column) -> DataFrame:
    """Read ``{"score": …, "reasoning": …}`` out of a scorer's free text; fall back on any defect."""
    parsed = df.withColumn("__reply", F.try_parse_json(
        blank_to_null(F.regexp_extract(reply, r"(?s)\{[^}]+\}", 0))))
    value = F.try_variant_get("__reply", "$.score", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get("__reply", "$.score", "string")
    number = (
        F.when(kind.isNull(), F.lit(0))
        .when(kind == "STRING", whole_number(text, "string"))
        .when(kind == "BOOLEAN", (text == "true").cast("int"))
        .otherwise(whole_number(text.try_cast("double")))
    )
    usable = F.col("__reply").isNotNull() & number.isNotNull()
    return parsed.withColumns({
        "score": F.when(usable, F.greatest(F.lit(0), F.least(F.lit(100), number))).otherwise(fallback_score),
        "reasoning": F.when(usable, F.coalesce(F.try_variant_get("__reply", "$.reasoning", "string"), F.lit("")))
        .otherwise(fallback_reason),
    }).drop("__reply")


INSTRUCTION = (
    "Rate the fit between the listing and the résumé. Answer with one JSON object: "
    '"score" from 0 to 100 and "reasoning" in one or two sentences.'
)


def prompt_text(
    listing: Column, resume: Column, instruction: str = INSTRUCTION, window: int | None = None,
) -> Column:
    """Batch input for an external scorer; a scorer that reads ``window`` characters only gets that much of each text."""
    def shown(text: Column) -> Column:
        return text if window is None else F.substring(text, 1, window)

    return F.concat(F.lit(instruction + "\n\nListing:\n"), shown(listing), F.lit("\n\nRésumé:\n"), shown(resume))


