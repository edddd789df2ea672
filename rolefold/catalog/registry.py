"""Query registry and the SQL fragments the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.entities import HTML_ENTITIES
from ..functions.rows import spread
from ..functions.text import SPACE_RANGES, WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its oracle if there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(scan) if heavy else scan


# -- oracle SQL ------------------------------------------------------------------------------

SPACES = f"'{WHITESPACE}'"
SPACE_RE = f"[{SPACE_RANGES}]"
WORD_RE = r"[\p{L}\p{N}_]"


def s_strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def s_collapse(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '{SPACE_RE}+', ' ', 'g')")


def s_unescape(x: str) -> str:
    """The references that occur in the test tables; '&amp' also counts where a text breaks off before its ';'."""
    for entity, char in HTML_ENTITIES[:-1]:
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{entity}', '{quoted}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def s_html_text(x: str) -> str:
    return s_collapse(f"regexp_replace({s_unescape(x)}, '<[^>]+>', ' ', 'g')")


def s_tokens(x: str) -> str:
    """Distinct words of three or more ASCII letters, sorted."""
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '{WORD_RE}+'), "
            "lambda w: regexp_full_match(w, '[a-z]{3,}'))))")


def s_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def s_fold(x: str) -> str:
    return f"lower(translate({x}, 'İıſK', 'iisk'))"


def s_pattern(pattern: str) -> str:
    """Lexicon pattern in a dialect without look-around: boundaries become neighbours."""
    body = pattern.replace(r"\s", SPACE_RE)
    head = f"(?:^|[^{WORD_RE[1:-1]}])" if body.startswith(r"\b") else ""
    body = body.removeprefix(r"\b")
    if body.endswith(r"+\b"):
        tail = WORD_RE
    else:
        tail = f"(?:$|[^{WORD_RE[1:-1]}])"
    return head + body.removesuffix(r"\b") + tail


def s_skills(x: str, lexicon: list[tuple[str, str]]) -> str:
    """List of the skills named in ``x`` (already case-folded), in lexicon order."""
    cases = ", ".join(
        f"CASE WHEN regexp_matches({x}, '{s_pattern(p)}') THEN '{name}' END" for name, p in lexicon)
    return f"list_filter([{cases}], lambda s: s IS NOT NULL)"
