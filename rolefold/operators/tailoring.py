"""Fitting a résumé to a listing: best bullets, relevant skills, summary, rendered page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, distinct_tokens
from .dedup import top_n

BULLETS_KEPT = 5  # fixed value
FALLBACK_SUMMARY = "Experienced professional seeking %s role at %s."


def overlap(text: Column, words: Column) -> Column:
    return F.size(F.array_intersect(distinct_tokens(text), words))


def best_bullets(bullets: Column, words: Column, n: int = BULLETS_KEPT) -> Column:
    """The n bullets sharing most words with the listing; equal ones keep their order."""
    ranked = F.array_sort(F.transform(bullets, lambda b, i: F.struct(
        (-overlap(b, words)).alias("k"), i.alias("i"), b.alias("b"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: r["b"])


def top_bullets(bullets: DataFrame, listings: DataFrame, pair: list[str], n: int = BULLETS_KEPT) -> DataFrame:
    """Table form: ``bullets(pair…, pos, text)`` against ``listings(pair…, words)``.

    Each bullet is joined to its own listing only; the best n per pair are picked before the
    shuffle and again after it.
    """
    scored = bullets.join(listings, pair).select(*pair, "pos", "text", overlap(F.col("text"), F.col("words")).alias("overlap"))
    return top_n(scored, pair, [F.col("overlap").desc(), F.col("pos")], n, rank="rank")


def relevant_skills(skills: Column, description: Column, words: Column) -> Column:
    """Skills named in the listing or containing one of its words; all of them when none is."""
    low = F.lower(description)
    kept = F.filter(skills, lambda s: F.contains(low, F.lower(s)) | F.exists(
        words, lambda w: F.contains(F.lower(s), w)))
    return F.when(F.size(kept) > 0, kept).otherwise(skills)


def summary_or_default(summary: Column, title: Column, company: Column) -> Column:
    return F.coalesce(blank_to_null(summary), F.format_string(FALLBACK_SUMMARY, title, company))


def tailor(df: DataFrame, title: str = "title", company: str = "company", description: str = "description") -> DataFrame:
    """Tailor résumé columns on rows that also carry the listing's columns.

    Works on each row's own copy, so what is cut for one listing is there for the next.
    """
    prepared = df.withColumn("__words", distinct_tokens(F.col(description)))
    jobs = F.transform("experience", lambda e: e.withField("bullets", best_bullets(e["bullets"], F.col("__words"))))
    return prepared.withColumns({
        "summary": summary_or_default(F.col("summary"), F.col(title), F.col(company)),
        "experience": jobs,
        "skills": relevant_skills(F.col("skills"), F.col(description), F.col("__words")),
    }).drop("__words")


def escape_text(col: Column) -> Column:
    # The characters that would break element content.
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _present(*parts: Column) -> Column:
    return F.array_compact(F.array(*[blank_to_null(p) for p in parts]))


def _block(heading: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"<h2>{heading}</h2><p>"), escape_text(text), F.lit("</p>"))).otherwise("")


STYLE = "body{font-family:sans-serif;margin:40px;line-height:1.6;max-width:800px}.skill{padding:4px 12px}"


def render_resume(
    name: Column, mail: Column, phone: Column, summary: Column, experience: Column, skills: Column,
    education: Column,
) -> Column:
    """Résumé page as one HTML string; blocks without content are left out."""
    title = escape_text(F.coalesce(name, F.lit("Resume")))
    contact = escape_text(F.array_join(_present(mail, phone), " \xb7 "))

    def job(e: Column) -> Column:
        header = F.concat(F.coalesce(e["role"], F.lit("")), F.when(
            e["company"] != "", F.concat(F.lit(" at "), e["company"])).otherwise(""))
        meta = F.array_join(_present(e["dates"], e["location"]), " \xb7 ")
        items = F.array_join(F.transform(e["bullets"], lambda b: F.concat(
            F.lit("    <li>"), escape_text(b), F.lit("</li>\n"))), "")
        return F.concat(
            F.lit('<div class="experience">\n  <h3>'), escape_text(header), F.lit("</h3>\n"),
            F.when(meta != "", F.concat(F.lit('  <div class="meta">'), escape_text(meta), F.lit("</div>\n"))).otherwise(""),
            F.when(F.size(e["bullets"]) > 0, F.concat(F.lit("  <ul>\n"), items, F.lit("  </ul>\n"))).otherwise(""),
            F.lit("</div>\n"))

    jobs = F.when(F.size(experience) > 0, F.concat(
        F.lit("<h2>Experience</h2>\n"), F.array_join(F.transform(experience, job), ""))).otherwise("")
    tags = F.array_join(F.transform(skills, lambda s: F.concat(
        F.lit('<span class="skill">'), escape_text(s), F.lit("</span>"))), "")
    skill_block = F.when(F.size(skills) > 0, F.concat(
        F.lit('<h2>Skills</h2>\n<div class="skills">'), tags, F.lit("</div>"))).otherwise("")
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>'), title,
        F.lit(f" - Resume</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<h1>"), title,
        F.lit('</h1>\n<div class="contact">'), contact, F.lit("</div>\n"),
        _block("Summary", F.coalesce(summary, F.lit(""))), F.lit("\n"), jobs, F.lit("\n"), skill_block, F.lit("\n"),
        _block("Education", F.coalesce(education, F.lit(""))), F.lit("\n</body>\n</html>"))


def rendered(df: DataFrame) -> Column:
    return render_resume(*[F.col(c) for c in ("name", "email", "phone", "summary", "experience", "skills", "education")])
