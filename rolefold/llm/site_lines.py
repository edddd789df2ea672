"""Line dedup by site-relative frequency: a line that a large share of a site's pages carry is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import GAPS

RATIO = 0.1                    # a line on more than this share of its site's pages is boilerplate
LEAST_PAGES = 4                # and it stands on so many pages at least
BROADCAST_LINES = 1_000_000    # boilerplate lines that are sent to every executor; more are joined by shuffle

BLOCK_TAGS = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|aside|main|pre|blockquote|form)\b[^>]*)>"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port, null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def trimmed_lines(text: Column) -> Column:
    """Lines with a word, without blanks at their ends; none for null."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(GAPS)))
    return F.filter(lines, lambda line: line != "")


def page_lines(html: Column) -> Column:
    """Visible lines of an HTML page: blocks end lines, tags, comments, scripts and styles go."""
    shown = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    return trimmed_lines(F.regexp_replace(F.regexp_replace(shown, BLOCK_TAGS, "\n"), "<[^>]*>", ""))


def line_hashes(lines: Column) -> Column:
    """Hashes of the different lines of a page, without empty ones."""
    return F.array_distinct(F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.xxhash64(line)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, once: bool = False) -> DataFrame:
    """Rows (site, bad) with the hashes of each site's boilerplate lines, from rows (site, lines).

    Counts are partial before the shuffle, so a line or site with a third of all rows sends one row per task. A page has
    its lines counted once; empty lines are never boilerplate. The list of a site has at most (lines per page / ratio) entries.
    With ``once``, pages of a site with the same lines count as one page.
    """
    known = pages.where(F.col("site").isNotNull())
    known = known.select("site", line_hashes(F.col("lines")).alias("hashes"))
    if once:
        known = materialise(known.groupBy("site", "hashes").agg(F.count(F.lit(1)).alias("copies")), "site-pages")
    counts = known.select("site", F.explode("hashes").alias("line")).groupBy("site", "line").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    totals = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(totals, "site").where(F.col("n") > ratio * F.col("pages")).groupBy("site").agg(
        F.array_sort(F.collect_list("line")).alias("bad"))


def drop_site_lines(pages: DataFrame, site: Column, lines: Column, same_line: Column | None = None, ratio: float = RATIO,
                    least_pages: int = LEAST_PAGES, first_by: Column | None = None) -> DataFrame:
    """``pages`` with three more columns: ``all_lines``, ``kept_lines`` (arrays) and ``n_dropped``.

    ``lines`` is an array of lines; ``same_line`` may give the array, as long, whose entries decide which lines are equal. Rows
    without a site keep all lines. Repeated rows count as pages of their own. Null or empty pages have no lines. Of the columns
    of ``pages``, those with the names ``all_lines``, ``kept_lines`` and ``n_dropped`` are replaced.

    With ``first_by``, copies count once: pages of a site with the same lines are one page, and of the pages that have a line of
    boilerplate, that with the smallest ``first_by`` keeps it. So every different line of a site stays somewhere.
    """
    shape = lines if same_line is None else same_line
    bad = materialise(boilerplate(pages.select(site.alias("site"), shape.alias("lines")), ratio, least_pages, first_by is not None), "site-lines")
    n_bad = bad.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0)).alias("n")).first()["n"]
    sent = F.broadcast if n_bad <= BROADCAST_LINES else lambda table: table
    own = [c for c in pages.columns if c not in ("all_lines", "kept_lines", "n_dropped")]
    named = pages.select(F.struct(*[F.col(c) for c in own]).alias("row"), site.alias("site"),
                         F.arrays_zip(lines.alias("line"), shape.alias("shape")).alias("all_lines"),
                         *([] if first_by is None else [first_by.alias("first_by")]))
    if first_by is None:
        gone = F.col("bad")
    else:
        carried = pages.select(site.alias("site"), first_by.alias("first_by"), line_hashes(shape).alias("hashes")).join(sent(bad), "site").select(
            "site", "first_by", F.explode(F.array_intersect("hashes", "bad")).alias("line"))
        firsts = materialise(carried.groupBy("site", "line").agg(F.min("first_by").alias("first_by")).groupBy("site", "first_by").agg(
            F.collect_list("line").alias("first_of")), "first-lines")
        named = named.withColumn("page_key", F.xxhash64("site", "first_by")).join(
            sent(firsts.select(F.xxhash64("site", "first_by").alias("page_key"), "first_of")), "page_key", "left").drop("page_key")
        gone = F.when(F.col("first_of").isNull(), F.col("bad")).otherwise(F.array_except("bad", "first_of"))
    kept = F.when(F.col("bad").isNull(), F.col("all_lines")).otherwise(
        F.filter("all_lines", lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(x["shape"]))))
    return named.join(sent(bad), "site", "left").withColumn("gone", gone).withColumn("kept_lines", kept).select(
        "row.*", F.col("all_lines.line").alias("all_lines"), F.col("kept_lines.line").alias("kept_lines"),
        (F.size("all_lines") - F.size("kept_lines")).cast("long").alias("n_dropped"))
