"""Plain-text résumés → structured columns, row by row with array functions.

Everything about one résumé sits in one row, so nothing here needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import let
from ..functions.text import blank_to_null, email, strip, strip_bullet

# Lines that open a section.
SECTION_HEADERS = [
    "professional experience", "work experience", "experience",
    "technical experience", "career history", "employment",
    "education", "academic background",
    "skills", "technical skills", "core technical skills",
    "technical expertise", "proficiencies", "competencies",
    "summary", "professional summary", "profile",
    "objective", "about", "about me", "overview",
    "certifications", "certificates", "licenses",
    "projects", "personal projects", "side projects",
    "publications", "awards", "languages", "interests",
    "references", "volunteer",
]

# Section names that feed each résumé field, in order of preference.
FIELD_SECTIONS = {
    "experience": ["professional experience", "work experience", "experience", "technical experience",
                   "career history", "employment"],
    "skills": ["skills", "technical skills", "core technical skills", "technical expertise", "proficiencies",
               "competencies"],
    "education": ["education", "academic background"],
    "summary": ["summary", "professional summary", "profile", "objective", "about", "about me", "overview"],
    "certifications": ["certifications", "certificates", "licenses"],
}
PREAMBLE = "header"


def stripped_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def sections(text: Column, headers: list[str] = SECTION_HEADERS) -> Column:
    """Array of ``(name, body)``, one entry per name; the last occurrence of a name counts.

    What precedes the first header is named ``header``. A header directly followed by another, or
    by the end of the text, opens nothing.
    """
    def cut(lines: Column) -> Column:
        marks = F.filter(
            F.transform(lines, lambda line, i: F.struct(
                i.alias("at"), F.rtrim(F.lower(line), F.lit(":")).alias("name"))),
            lambda m: m["name"].isin(headers))
        start = F.array(F.struct(F.lit(-1).alias("at"), F.lit(PREAMBLE).alias("name")))

        def bodies(marks: Column) -> Column:
            def body(mark: Column, k: Column) -> Column:
                until = F.coalesce(F.get(marks, k + 1)["at"], F.size(lines))
                return F.struct(mark["name"].alias("name"),
                                F.slice(lines, mark["at"] + 2, until - mark["at"] - 1).alias("lines"))

            return F.filter(F.transform(marks, body), lambda s: F.size(s["lines"]) > 0)

        return let(F.concat(start, marks), bodies)

    def last_of_each(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda s: s["name"]))
        return F.transform(names, lambda n: F.struct(n.alias("name"), strip(F.array_join(F.element_at(
            F.filter(found, lambda s: s["name"] == n), -1)["lines"], "\n")).alias("body")))

    return let(let(stripped_lines(text), cut), last_of_each)


def pick_section(by_name: Column, names: list[str]) -> Column:
    """First non-empty body among several section names."""
    return F.coalesce(*[blank_to_null(F.try_element_at(by_name, F.lit(n))) for n in names])


def person_name(text: Column) -> Column:
    short = lambda line: (line != "") & (F.length(line) < 60) & ~line.rlike("(?s)^.+@.+")
    return F.get(F.filter(stripped_lines(text), short), F.lit(0))


def skill_items(text: Column) -> Column:
    """Items of a skills or certifications section."""
    lines = F.filter(stripped_lines(text), lambda line: line != "")
    parts = F.flatten(F.transform(lines, lambda line: F.split(strip_bullet(line), r"[,;|\x{b7}]")))
    return F.filter(F.transform(parts, strip), lambda p: (p != "") & (F.length(p) < 50))


def _is_upper(line: Column) -> Column:
    return (F.upper(line) == line) & (F.lower(line) != line)


def _bullets(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: strip_bullet(x["line"])), lambda b: b != "")


def _tail(array: Column, first: Column | int) -> Column:
    return F.slice(array, first, F.size(array))


def experience_entries(text: Column) -> Column:
    """Entries of an experience section in either layout.

    An all-capitals line of more than five characters always opens a new stretch. A stretch whose
    first line has pipes holds one entry per pipe line; any other stretch is a single entry:
    company, role on the very next line, bullets.
    """
    def stretch_of(lines: Column, starts: Column) -> Column:
        return F.transform(starts, lambda s, k: F.slice(
            lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s))

    def positions(lines: Column, opens) -> Column:
        numbered = F.transform(lines, lambda x, k: F.when((k == 0) | opens(x), k))
        return F.array_compact(numbered)

    def piped(part: Column) -> Column:
        cells = F.transform(F.split(F.get(part, F.lit(0))["line"], r"\|"), strip)
        cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
        return F.struct(cell(0).alias("company"), cell(1).alias("role"), cell(2).alias("dates"),
                        cell(3).alias("location"), _bullets(_tail(part, 2)).alias("bullets"))

    def plain(part: Column) -> Column:
        head, following = F.get(part, F.lit(0)), F.get(part, F.lit(1))
        has_role = F.coalesce((following["at"] == head["at"] + 1) & ~_is_upper(following["line"]), F.lit(False))
        return F.struct(
            head["line"].alias("company"), F.when(has_role, following["line"]).otherwise("").alias("role"),
            F.lit("").alias("dates"), F.lit("").alias("location"),
            _bullets(F.when(has_role, _tail(part, 3)).otherwise(_tail(part, 2))).alias("bullets"))

    def entries(stretch: Column) -> Column:
        has_pipe = lambda x: F.contains(x["line"], F.lit("|"))
        by_pipe = let(positions(stretch, has_pipe), lambda at: F.transform(stretch_of(stretch, at), piped))
        return F.when(has_pipe(F.get(stretch, F.lit(0))), by_pipe).otherwise(F.array(plain(stretch)))

    def build(lines: Column) -> Column:
        hard = lambda x: _is_upper(x["line"]) & (F.length(x["line"]) > 5)
        return let(positions(lines, hard), lambda at: F.flatten(F.transform(stretch_of(lines, at), entries)))

    numbered = F.transform(stripped_lines(text), lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    return let(F.filter(numbered, lambda x: x["line"] != ""), build)


def structure_resumes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the résumé columns to rows of plain text."""
    named = df.withColumn("__sections", F.map_from_entries(sections(F.col(text))))
    picked = named.withColumns({
        f"__{field}": pick_section(F.col("__sections"), names) for field, names in FIELD_SECTIONS.items()
    })
    none = F.array().cast("array<string>")
    no_jobs = F.array().cast("array<struct<company:string,role:string,dates:string,location:string,bullets:array<string>>>")
    return picked.withColumns({
        "name": person_name(F.col(text)),
        "email": email(F.col(text)),
        "phone": F.lit(None).cast("string"),
        "summary": F.coalesce(strip(F.col("__summary")), F.lit("")),
        "experience": F.coalesce(experience_entries(F.col("__experience")), no_jobs),
        "skills": F.coalesce(skill_items(F.col("__skills")), none),
        "education": F.coalesce(strip(F.col("__education")), F.lit("")),
        "certifications": F.coalesce(skill_items(F.col("__certifications")), none),
    }).drop("__sections", *[f"__{f}" for f in FIELD_SECTIONS])
