"""Finding elements in HTML text columns with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.entities import unescape
from ..functions.rows import let
from ..functions.text import blank_to_null, collapse_spaces, strip


def class_attr(*names: str) -> str:
    """Regex for a class attribute that holds one of the names."""
    return rf'class\s*=\s*"(?:[^"]*\s)?(?:{"|".join(names)})(?:\s[^"]*)?"'


def opening(tag: str, *classes: str) -> str:
    return rf"<(?:{tag})\b[^>]*{class_attr(*classes)}[^>]*>" if classes else rf"<(?:{tag})\b[^>]*>"


def inner(html: Column, tag: str, *classes: str) -> Column:
    """Content of the first such element without nested elements of the same tag; null if absent."""
    start = opening(tag, *classes)
    found = F.regexp_extract(html, rf"(?is){start}(.*?)</(?:{tag})\s*>", 1)
    return F.when(html.rlike(f"(?is){start}"), found)


def open_tag(html: Column, tag: str, *classes: str) -> Column:
    """The first matching opening tag itself, for reading its attributes."""
    return blank_to_null(F.regexp_extract(html, f"(?is){opening(tag, *classes)}", 0))


def raw_attribute(tag_text: Column, name: str) -> Column:
    return F.regexp_extract(tag_text, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)


def attribute(tag_text: Column, name: str) -> Column:
    return unescape(raw_attribute(tag_text, name))


def balanced_inner(html: Column, tag: str, *classes: str) -> Column:
    """Content of the first such element up to its own closing tag, nested ones included."""
    start = opening(tag, *classes)
    after = F.regexp_replace(html, f"(?is)^.*?{start}", "")

    def cut(pieces: Column) -> Column:
        # The first piece may be plain text, every other one begins with a tag.
        def step(piece: Column) -> Column:
            return F.when(piece.rlike(rf"(?i)^</{tag}\s*>"), -1).when(piece.rlike(rf"(?i)^<{tag}\b"), 1).otherwise(0)

        state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("kept"), F.lit(False).alias("closed"))

        def advance(acc: Column, piece: Column) -> Column:
            depth = acc["depth"] + step(piece)
            closed = acc["closed"] | (depth < 0)
            return F.struct(depth.alias("depth"), F.when(closed, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
                            closed.alias("closed"))

        kept = F.aggregate(pieces, state, advance)["kept"]
        return F.array_join(F.slice(pieces, 1, kept), "")

    pieces = F.split(after, rf"(?i)(?=<{tag}\b|</{tag}\s*>)")
    return F.when(html.rlike(f"(?is){start}"), let(pieces, cut))


def pieces_from(html: Column, start: str, *tags: str) -> Column:
    """The elements whose opening tag matches ``start``, each up to its end or to the next match.

    ``tags`` are the tag names that ``start`` may match.
    """
    def own(piece: Column) -> Column:
        head = F.regexp_extract(piece, "(?s)^<[^>]*>", 0)
        cut = piece
        for tag in tags:
            cut = F.when(piece.rlike(rf"(?i)^<{tag}\b"), F.concat(head, balanced_inner(piece, tag))).otherwise(cut)
        return cut

    found = F.filter(F.split(html, f"(?is)(?={start})"), lambda p: p.rlike(f"(?is)^(?:{start})"))
    return F.transform(found, own)


def joined_text(fragment: Column) -> Column:
    """Text nodes stripped one by one and joined without a blank."""
    parts = F.transform(F.split(fragment, "<[^>]+>"), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "")


def shown_text(fragment: Column) -> Column:
    """Text as displayed on one line."""
    return collapse_spaces(unescape(F.regexp_replace(fragment, "<[^>]+>", " ")))


def shown_lines(fragment: Column) -> Column:
    """Displayed text with a line break after every block element, as an array of non-blank lines."""
    broken = F.regexp_replace(fragment, r"(?i)<br\s*/?>|</(?:div|p|h[1-6]|li|ul|section|article)\s*>", "\n")
    lines = F.split(unescape(F.regexp_replace(broken, "<[^>]+>", "")), "\n")
    return F.filter(F.transform(lines, strip), lambda x: x != "")
