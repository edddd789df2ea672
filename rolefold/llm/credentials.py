"""Secrets in whole texts, with weak candidates that count only beside a complementary part.

A leaked credential has several parts: an identifier, a secret, and often an endpoint. Parts of a clear form are reported as they
are. Parts of a weak form (an account name, a long random-looking word, a web address) are common in clean text; they are
reported only if an interval join within their scope finds a part that completes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SCOPE = 200     # characters between two parts that may belong together

#: Kind, pattern, group whose length counts, least length. The first three are the base; their matches are never changed.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    ("account", r"""(?i)\b(?:access_?key_?id|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0, 0),
    ("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}", 0, 0),
    ("endpoint", r"""https?://[^\x00-\x20"'<>]+""", 0, 0),
)
BASE = 3
#: For each weak kind, the sets of kinds that complete it: a part of the base of another role, or weak parts of both other roles.
COMPLETED_BY = {3: ((0,), (2,), (4, 5)), 4: ((1,), (3, 5)), 5: ((0,), (1,), (2,), (3, 4))}
#: For each weak kind, the kinds that it yields to where it overlaps them.
YIELDS_TO = {3: (0, 1, 2), 5: (0, 1, 2, 3), 4: (0, 1, 2, 3, 5)}


def _matches(text: Column, kind: int) -> Column:
    """Structs (kind, i, gap, size, fits) of a kind's leftmost matches: the gap is what stands before a match since the last one."""
    _, pattern, group, least = KINDS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
                         F.split(text, pattern, -1).alias("gap"))
    found = F.transform(F.filter(parts, lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("size"),
        (F.char_length(x["value"]) >= least).alias("fits")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,fits:boolean>>"))


def credential_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, kind, start, end) of all parts, weak ones whether completed or not; positions in code points, end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_matches(text, k) for k in range(len(KINDS))])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.inline(found)).distinct()
    end = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).where("fits").select("doc_id", "text_hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The base parts, and the weak parts that complementary ones complete.

    Two parts belong together if they do not overlap and at most ``scope`` characters lie between them. A weak part needs a part of the base that has
    another role beside it; two weak parts need a third, so that all three roles are there. Each part is two points, its start and its end: the
    nearest part before it has the last end up to its start, the nearest after it the first start from its end on, so running extremes over the
    points find partners without pairing parts. A weak part that overlaps a base part, or a weak one that comes before it in ``YIELDS_TO``, is that part
    again: it is neither reported nor a partner, so one string never completes itself.
    """
    document = Window.partitionBy("doc_id", "text_hash")
    by_start = document.orderBy("start", "kind", "end")
    again = F.lit(False)
    for kind, kinds in YIELDS_TO.items():
        last_end = F.max(F.when(F.col("kind").isin(*kinds), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        next_start = F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
        over = F.coalesce(last_end > F.col("start"), F.lit(False)) | F.coalesce(next_start < F.col("end"), F.lit(False))
        again = F.when(F.col("kind") == kind, over).otherwise(again)
    points = parts.withColumn("again", again).where("not again").withColumn("point", F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("at"), F.lit(False).alias("opens")))))
    at, opens = F.col("point.at"), F.col("point.opens")
    until = document.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = document.orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing)

    def near(kind: int) -> Column:
        before = at - F.max(F.when(~opens & (F.col("kind") == kind), at)).over(until) <= scope
        after = F.min(F.when(opens & (F.col("kind") == kind), at)).over(since) - at <= scope
        return F.coalesce(F.when(opens, before).otherwise(after), F.lit(False))

    kinds = sorted({k for sets in COMPLETED_BY.values() for kinds in sets for k in kinds})
    seen = points.select("doc_id", "text_hash", "kind", "start", "end", *[near(k).alias(f"near_{k}") for k in kinds])
    whole = seen.groupBy("doc_id", "text_hash", "kind", "start", "end").agg(*[F.max(f"near_{k}").alias(f"near_{k}") for k in kinds])
    complete = F.lit(False)
    for kind, sets in COMPLETED_BY.items():
        one = reduce(Column.__or__, [reduce(Column.__and__, [F.col(f"near_{k}") for k in kinds]) for kinds in sets])
        complete = F.when(F.col("kind") == kind, one).otherwise(complete)
    return whole.where((F.col("kind") < BASE) | complete).select("doc_id", "text_hash", "kind", "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per row of ``docs``.

    ``spans`` lists kind:start:end by start, then kind. Null texts count as empty ones; empty texts have no spans. Rows equal in id and text have the
    same result, null ids are ids like others, other columns are ignored, and an empty table gives no rows. Kinds beyond the base are listed after it.
    """
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    spans = linked_parts(credential_parts(docs, id_col, text_col)).withColumn("span", F.concat_ws(":", name, F.col("start"), F.col("end")))

    def listed(which: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(which, F.struct("start", "kind", "end", "span"))))
        return F.array_join(F.transform(ordered, lambda x: x["span"]), ",")

    found = spans.groupBy("doc_id", "text_hash").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        listed(F.col("kind") < BASE).alias("base"), listed(F.lit(True)).alias("spans")).withColumnRenamed("doc_id", "found_id").withColumnRenamed(
        "text_hash", "found_hash")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    counts = [F.coalesce(f"n_{KINDS[k][0]}", F.lit(0)).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    return rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"]) & (rows["text_hash"] == found["found_hash"]), "left").select(
        "doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
