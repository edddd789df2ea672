"""Quality rules as a short-circuit cascade.

Each rule rejects a document or passes it on. What a rule costs and how many documents it rejects is measured on a bounded sample;
the rules then run in the order of rejections per second, and a document that one of them rejects is
not put before the others. The order decides how much work is done, never which documents stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import let
from .common import GAPS, n_words, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SAMPLE_ROWS, SAMPLE_BYTES = 500, 1 << 16


def word_chars(text: Column) -> Column:
    return let(words(text), _chars)


def _chars(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, w: total + F.char_length(w))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(GAPS)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_repeat_words(text: Column) -> Column:
    """Words inside windows of five words that the text has twice or more."""
    return let(words(text), _repeated)


def _repeated(found: Column) -> Column:
    return F.when(F.size(found) <= WINDOW, F.lit(0).cast("long")).otherwise(let(_windows(found), _covered))


def _windows(found: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(found) - WINDOW), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(WINDOW)]))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice; most texts have none, which takes one pass to see."""
    def neighbours(placed: Column) -> Column:
        return F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"]) | (x["h"] == F.get(placed, i + 1)["h"]))

    def total(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.when(i > 0, F.least(F.lit(WINDOW), x - F.get(starts, i - 1))).otherwise(0))
        return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda sum_, step: sum_ + step)

    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(placed, lambda p: F.array_sort(F.transform(neighbours(p), lambda x: x["i"])))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(starts, total))


#: Measure by name; each is a column expression of the text.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines,
    "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
    "n_capitals": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")), F.lit(0)).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function from the name of a measure to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
)
RULES = (
    *BASE_RULES,
    # Fewer than 2 or more than 30 characters a word, in one comparison.
    Rule("word_length", lambda m: F.abs(m("word_chars") - 16 * m("n_words")) > 14 * m("n_words")),
    Rule("symbols", lambda m: 4 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("capitals", lambda m: 2 * m("n_capitals") > m("word_chars")),
)


def _from_words(text: Column, found: Column) -> Callable[[str], Column]:
    """As ``_from_text``, for a text that is split into words already."""
    own = {"n_words": lambda: F.size(found).cast("long"), "word_chars": lambda: _chars(found), "n_repeat_words": lambda: _repeated(found)}
    return lambda name: own[name]() if name in own else MEASURES[name](text)


def _from_text(text: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """The rules by rejections per second, measured on the first ``sample_rows`` rows; rules that reject nothing come last, cheap ones first.

    Only the first rows are read, and of texts up to ``SAMPLE_BYTES``, so this costs the same for any size of the input. A biased sample
    costs time, not correctness.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    short = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES).select(text.cast("string").alias("text"))
    sample = spark.createDataFrame(short.take(sample_rows), "text string")

    def seconds(rejects: Column) -> tuple[float, int]:
        started = time.perf_counter()
        n = sample.agg(F.count(F.when(rejects, 1)).alias("n")).first()["n"]
        return time.perf_counter() - started, n

    seconds(F.col("text").isNull())
    idle = seconds(F.col("text").isNull())[0]
    measured = []
    for rule in rules:
        spent, rejected = seconds(rule.rejects(_from_text(F.col("text"))))
        measured.append((-rejected / max(spent - idle, 0.001), spent, rule.name, rule))
    return [rule for *_, rule in sorted(measured, key=lambda x: x[:3])]


def first_rejection(rules: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, or null. Later rules are not evaluated once one rejects."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(measure), F.lit(rule.name)).otherwise(verdict)
    return verdict


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    Null and empty texts have no words and are rejected; repeated rows share their fate. An empty table stays empty.
    """
    ordered, text = cascade_order(docs, rules, text_col=text_col), F.col(text_col)
    # Words are split once; everything else is computed when a rule asks for it.
    return docs.where(let(words(text), lambda found: first_rejection(ordered, _from_words(text, found)).isNull()))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one per row of ``docs``.

    As all measures are wanted here, they are computed once per row, and the cascade reads them. Null and empty texts have
    0 everywhere and fail. Other columns are ignored.
    """
    text = F.col(text_col)

    def measures(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"), _chars(found).alias("word_chars"), n_symbols(text).alias("n_symbols"),
            n_lines(text).alias("n_lines"), n_dup_lines(text).alias("n_dup_lines"), _repeated(found).alias("n_repeat_words"),
            MEASURES["n_capitals"](text).alias("n_capitals"))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.transform(F.array(words(text)), measures)))
    ordered = cascade_order(docs, rules, text_col=text_col)
    base_failed = first_rejection(list(BASE_RULES), F.col).isNotNull()
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & first_rejection(ordered, F.col).isNull()).alias("kept"))
