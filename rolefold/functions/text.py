"""String expressions. All of them stay on the JVM side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from .entities import unescape
from .rows import let

# The characters a Unicode-aware strip removes and ``\s`` matches.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RANGES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CLASS = f"[{SPACE_RANGES}]"
# The same, but for the blank, in a form that rules out most characters by two tests.
NO_BLANK = (
    r"\x{9}\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
# Word characters in the Unicode sense. Java's own ``\b`` would also count combining marks.
WORD_CLASS = r"[\p{L}\p{N}_]"
NO_WORD_BEFORE = rf"(?<!{WORD_CLASS})"
NO_WORD_AFTER = rf"(?!{WORD_CLASS})"
TOKEN_PATTERN = rf"{NO_WORD_BEFORE}[a-z]{{3,}}+{NO_WORD_AFTER}"
WORD_PATTERN = rf"{WORD_CLASS}++"

BULLET_MARKERS = r"^[-\x{2022}*\x{b7}]+"
EMAIL_PATTERN = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"


def strip(col: Column) -> Column:
    """Remove every kind of Unicode whitespace from both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    """Null for the empty string; a blank string is kept."""
    return F.nullif(col, F.lit(""))


def collapse_spaces(col: Column) -> Column:
    """One blank for each run of whitespace; single blanks, by far the most, are not touched."""
    return strip(F.regexp_replace(col, rf"[{NO_BLANK}][\x{{20}}{NO_BLANK}]*+| [\x{{20}}{NO_BLANK}]++", " "))


def fold_case(col: Column) -> Column:
    """Lower case in which an ASCII letter also stands for its case-insensitive look-alikes; texts without them, by far the most, are not translated."""
    alike = "\u0130\u0131\u017f\u212a"
    some = reduce(or_, [F.contains(col, F.lit(c)) for c in alike])
    return F.lower(F.when(some, F.translate(col, alike, "iisk")).otherwise(col))


def tokens(col: Column) -> Column:
    """All words of three or more ASCII letters, lower-cased, repeats kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def distinct_tokens(col: Column) -> Column:
    return F.array_distinct(tokens(col))


def strip_tags(col: Column) -> Column:
    return collapse_spaces(let(col, lambda text: F.when(
        F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)))


def html_to_text(col: Column, decode_entities: bool = True) -> Column:
    """Entities first, tags second: an escaped tag is removed like a plain one."""
    col = F.coalesce(col, F.lit(""))
    return strip_tags(unescape(col) if decode_entities else col)


def html_escape(col: Column) -> Column:
    # The five characters with a meaning in HTML, '&' first.
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def strip_bullet(line: Column) -> Column:
    return F.regexp_replace(line, BULLET_MARKERS + SPACE_CLASS + "*", "")


def email(col: Column) -> Column:
    return blank_to_null(F.regexp_extract(col, EMAIL_PATTERN, 0))


def keyword_slug(col: Column, suffix: str = "") -> Column:
    """Search-page slug; two portals append ``-jobs``."""
    kept = F.regexp_replace(col, f"[^a-zA-Z0-9{SPACE_RANGES}-]", "")
    slug = F.regexp_replace(F.lower(strip(kept)), rf"(?:{SPACE_CLASS}|-)+", "-")
    return F.concat(slug, F.lit(suffix)) if suffix else slug


def title_slug(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))


def last_segment(col: Column) -> Column:
    """Tail of a slash-separated id, trailing slashes ignored."""
    return F.element_at(F.split(F.rtrim(col, F.lit("/")), "/"), -1)


# Where each portal keeps the numeric id in a listing URL.
URL_ID_PATTERNS = {
    "LinkedIn": [r"view/.*?([0-9]{7,})", r"-([0-9]{7,})(?:\?|$)"],
    "Naukri": [r"-([0-9]{6,})(?:\?|$)"],
    "Hirist": [r"-([0-9]{5,})"],
    "Wellfound": [r"/jobs/([0-9]{5,})"],
}


def url_id(col: Column, portal: str) -> Column:
    """Id found in the URL, else null (the key then falls back to a content hash)."""
    return F.coalesce(*[
        blank_to_null(F.regexp_extract(col, pattern, 1)) for pattern in URL_ID_PATTERNS[portal]
    ])


def hash_key(*parts: Column) -> Column:
    """16 hex digits over the lower-cased parts."""
    seed = F.concat_ws(":", *[F.lower(p) for p in parts])
    return F.substring(F.sha2(seed, 256), 1, 16)


def contains_any(haystack: Column, needles: list[str]) -> Column:
    """True when any needle occurs; true as well when there are none."""
    wanted = split_keywords(needles)
    if not wanted:
        return F.lit(True)
    found = F.lit(False)
    for needle in wanted:
        found = found | F.contains(haystack, F.lit(needle))
    return found


def keyword_terms(keywords: str | list[str] | None) -> list[str]:
    """Trimmed keywords from a list or a comma string; blanks dropped."""
    if not keywords:
        return []
    parts = keywords.split(",") if isinstance(keywords, str) else keywords
    return [p.strip() for p in parts if p.strip()]


def split_keywords(keywords: str | list[str] | None) -> list[str]:
    """The same in lower case, for matching."""
    return [k.lower() for k in keyword_terms(keywords)]


def keyword_list(col: Column) -> Column:
    """The same for a column of comma strings, case kept."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda k: k != "")
