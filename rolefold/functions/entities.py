"""HTML character references, decoded as browsers do, in built-in expressions."""

from __future__ import annotations

from html import unescape as decode_one
from html.entities import html5

from pyspark.sql import Column, functions as F

from .rows import let

# References decoded by plain replacement; '&amp;' comes last so that '&amp;lt;'
# becomes '&lt;', as a single decoding pass gives.
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "\xa9"), ("&middot;", "\xb7"),
    ("&amp;", "&"),
]

# One reference at the start of a text, without its '&'.
REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# A reference that the plain replacements do not cover.
OTHER_REFERENCE = "&(?!(?:" + "|".join(e[1:-1] for e, _ in HTML_ENTITIES) + r");)(?:#[0-9xX]|[^\t\n\f <&#;])"

# Names that count even without a semicolon, and the longest of them.
OPEN_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
LONGEST_OPEN = max(map(len, OPEN_NAMES))
# Numbers 128 to 159 stand for the characters of an old Windows code page, one each.
REMAPPED = "".join(decode_one(f"&#{n};") for n in range(0x80, 0xA0))
REPLACEMENT = "�"


def _table(entries: dict[str, str]) -> Column:
    """A constant map. Two joined strings instead of thousands of literals keep the plan small."""
    sep = "\x1e"
    return F.map_from_arrays(F.split(F.lit(sep.join(entries)), sep), F.split(F.lit(sep.join(entries.values())), sep))


def _character(number: Column) -> Column:
    """The character with this code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(run: Column) -> Column:
    digits = F.regexp_replace(run, "^#[xX]?|;$", "")
    number = F.when(run.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("decimal(38,0)")
    known = F.when(number <= 0x10FFFF, number).cast("bigint")
    unwanted = (
        known.between(0x1, 0x8) | known.between(0xE, 0x1F) | known.between(0x7F, 0x9F) | known.between(0xFDD0, 0xFDEF)
        | (known == 0xB) | (F.pmod(known, F.lit(0x10000)) >= 0xFFFE))
    return (
        F.when(known.isNull() | (known == 0) | known.between(0xD800, 0xDFFF), F.lit(REPLACEMENT))
        .when(known.between(0x80, 0x9F), F.substr(F.lit(REMAPPED), known.cast("int") - 0x7F, F.lit(1)))
        .when(unwanted, F.lit(""))
        .otherwise(_character(known)))


def _named(run: Column) -> Column:
    """Value of the name, else of its longest beginning that counts without a semicolon."""
    open_names = _table(OPEN_NAMES)
    begun = [
        F.when(F.length(run) > n, F.concat(F.try_element_at(open_names, F.substring(run, 1, n)), F.substr(run, F.lit(n + 1))))
        for n in range(LONGEST_OPEN, 1, -1)
    ]
    return F.coalesce(F.try_element_at(_table(html5), run), *begun, F.concat(F.lit("&"), run))


def _value(run: Column) -> Column:
    """Character of a reference without its '&'; the empty text for a piece without one."""
    return F.when(run == "", "").when(F.startswith(run, F.lit("#")), _numeric(run)).otherwise(_named(run))


def unescape(col: Column) -> Column:
    """Decode all references once. Texts with only the usual ones take plain replacements, those without any nothing."""
    return let(col, _unescape)


def _unescape(text: Column) -> Column:
    plain = text
    for entity, char in HTML_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(~F.contains(text, F.lit("&")), text).when(text.rlike(OTHER_REFERENCE), _decode_all(text)).otherwise(plain)


def _decode_all(text: Column) -> Column:
    """Each distinct piece that begins with a reference is decoded once, whatever number of them a text has."""
    pieces = F.split(text, "(?=&)")
    run = F.transform(pieces, lambda p: F.regexp_extract(p, REFERENCE, 1))

    def joined(runs: Column) -> Column:
        distinct = F.array_distinct(runs)
        return let(F.map_from_arrays(distinct, F.transform(distinct, _value)), lambda values: F.array_join(
            F.zip_with(pieces, runs, lambda p, r: F.when(r == "", p).otherwise(F.concat(F.try_element_at(values, r), F.substr(p, F.length(r) + 2)))), ""))

    return let(run, joined)
