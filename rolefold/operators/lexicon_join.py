"""Names of a lexicon that comes as a table, found in texts by one equi-join.

``functions.lexicon`` turns a lexicon into expressions, so its cost is that of the lexicon times the texts. Here the phrases of each text, of as many words as the lexicon's forms
have, are made once and meet the forms by equality; a longer lexicon costs a larger join side and nothing per text. A regular expression is only looked at
where the form that goes with it occurs. Of a lexicon of few words, a phrase is only made where each of its words occurs at that place of a form.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import settle
from ..functions.text import SPACE_RANGES, WORD_CLASS, fold_case, strip

BREAK = "\x01"       # stands for whatever parts two words besides blanks
FEW_WORDS = 4_000    # of forms, counted at each place; a longer lexicon is met by all phrases

Places = dict[tuple[int, int], list[str]]


def word_list(text: Column) -> Column:
    """Folded words in order; whatever parts them other than blanks stays as one mark."""
    marked = F.regexp_replace(fold_case(text), f"[^{WORD_CLASS[1:-1]}{SPACE_RANGES}]+", f" {BREAK} ")
    return F.split(strip(marked), f"[{SPACE_RANGES}]+")


def phrases(words: Column, lengths: list[int], places: Places | None = None) -> Column:
    """Distinct phrases of these numbers of consecutive words, none of them across a mark.

    ``places`` has, by number of words and place, the words that count there; other phrases are left out before they are put together.
    """
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        if places is not None:
            starts = F.filter(starts, lambda i: reduce(and_, [F.get(words, i + j).isin(places[n, j]) for j in range(n)]))
        # Word by word: a slice would copy all the words for every phrase.
        found = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    joined = words if lengths == [1] and places is None else F.flatten(F.array(*[of(n) for n in lengths]))
    return F.array_distinct(joined if places is not None else F.filter(joined, lambda p: ~F.contains(p, F.lit(BREAK)) & (p != "")))


def few_places(forms: DataFrame) -> Places | None:
    """The words of each place of the forms, or None where they are more than ``FEW_WORDS``."""
    at = forms.select("n", F.posexplode(F.split("phrase", " ")).alias("place", "word")).distinct().limit(FEW_WORDS + 1).collect()
    if len(at) > FEW_WORDS:
        return None
    places: Places = {}
    for row in at:
        places.setdefault((row["n"], row["place"]), []).append(row["word"])
    return places


def lexicon_join(texts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Distinct (key, name): the names of ``lexicon`` whose form occurs in a text.

    ``lexicon`` has (name, form[, pattern]), a form being words with blanks between them, compared without regard to case and at word borders, with any blanks in the text. Where there is a
    ``pattern``, it must match the folded text as well. Forms that hold anything but words and blanks, and null or blank ones, never occur. Null and blank texts name nothing;
    rows with equal keys are one text each, and their names are given once per key.
    """
    forms = lexicon.select("name", F.array_join(word_list(F.coalesce("form", F.lit(""))), " ").alias("phrase"),
                           (F.col("pattern") if "pattern" in lexicon.columns else F.lit(None).cast("string")).alias("pattern")).where(
        (F.col("phrase") != "") & ~F.contains("phrase", F.lit(BREAK))).withColumn("n", F.size(F.split("phrase", " ")))
    places = few_places(forms)
    # As many numbers as the longest form has words.
    lengths = sorted({n for n, _ in places} if places is not None else {r["n"] for r in forms.select("n").distinct().collect()})
    patterned = "pattern" in lexicon.columns
    if not lengths:
        return texts.select(key, F.lit(None).cast("string").alias("name")).limit(0)
    named = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # The words are made once per text; every phrase then only cuts a piece out of them.
    words = settle(named, {"words": word_list(F.coalesce("text", F.lit("")))}, ["key", "text"] if patterned else ["key"])
    kept = settle(words, {"phrases": phrases(F.col("words"), lengths, places)}, [c for c in words.columns if c != "words"])
    if not patterned:
        hits = kept.select("key", F.explode("phrases").alias("phrase")).join(forms, "phrase")
        return hits.select(F.col("key").alias(key), "name").distinct()
    # A text is told apart from others with its key by a digest, and is only sent where a form with a pattern occurs.
    kept = kept.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    hits = kept.select("key", "digest", F.explode("phrases").alias("phrase")).join(forms, "phrase").select("key", "digest", "name", "pattern").distinct()
    plain = hits.where("pattern is null").select("key", "name")
    asked = hits.where("pattern is not null").groupBy("key", "digest").agg(F.collect_set(F.struct("name", "pattern")).alias("asked"))
    held = kept.select("key", "digest", "text").dropDuplicates(["key", "digest"])
    same = asked["key"].eqNullSafe(held["key"]) & (asked["digest"] == held["digest"])
    checked = asked.join(held, same).select(asked["key"].alias("key"), "text", F.explode("asked").alias("one")).where(
        F.rlike(fold_case(F.col("text")), F.col("one.pattern"))).select("key", "one.name")
    return plain.unionByName(checked).select(F.col("key").alias(key), "name").distinct()
