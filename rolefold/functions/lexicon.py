"""Skill lexicon: which named skills does a text mention?

A lexicon is an ordered list of ``(name, regex)``. Patterns that amount to "one of these words
occurs" are answered together from a single pass over the text; the few others run as literal
regexes behind a substring test.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .rows import settle
from .text import NO_WORD_AFTER, NO_WORD_BEFORE, SPACE_CLASS, WORD_CLASS, WORD_PATTERN, fold_case

# Skill names and their patterns, in reporting order.
SKILL_LEXICON = [
    ("Python", r"\bpython\b"),
    ("JavaScript", r"\bjavascript\b"),
    ("TypeScript", r"\btypescript\b"),
    ("React", r"\breact(?:\.js)?\b"),
    ("Node.js", r"\bnode(?:\.js)?\b"),
    ("Data Science", r"\bdata\s+science\b"),
    ("Machine Learning", r"\bmachine\s+learning\b"),
    ("Deep Learning", r"\bdeep\s+learning\b"),
    ("Artificial Intelligence", r"\bartificial\s+intelligence\b"),
    ("FastAPI", r"\bfastapi\b"),
    ("Django", r"\bdjango\b"),
    ("Flask", r"\bflask\b"),
    ("AWS", r"\baws\b"),
    ("Azure", r"\bazure\b"),
    ("GCP", r"\bgcp\b"),
    ("Docker", r"\bdocker\b"),
    ("Kubernetes", r"\bkubernetes\b"),
    ("Terraform", r"\bterraform\b"),
    ("SQL", r"\bsql\b"),
    ("NoSQL", r"\bnosql\b"),
    ("MongoDB", r"\bmongodb\b"),
    ("PostgreSQL", r"\bpostgresql\b"),
    ("MySQL", r"\bmysql\b"),
    ("API", r"\bapi\b"),
    ("REST", r"\brest(?:ful)?\b"),
    ("GraphQL", r"\bgraphql\b"),
    ("gRPC", r"\bgrpc\b"),
    ("CI/CD", r"\bci/cd\b"),
    ("DevOps", r"\bdevops\b"),
    ("Agile", r"\bagile\b"),
    ("Scrum", r"\bscrum\b"),
    ("Git", r"\bgit\b"),
    ("Linux", r"\blinux\b"),
    ("Bash", r"\bbash\b"),
    ("PowerShell", r"\bpowershell\b"),
    ("Pandas", r"\bpandas\b"),
    ("NumPy", r"\bnumpy\b"),
    ("Scikit-Learn", r"\bscikit(?:-learn)?\b"),
    ("TensorFlow", r"\btensorflow\b"),
    ("PyTorch", r"\bpytorch\b"),
    ("Excel", r"\bexcel\b"),
    ("Tableau", r"\btableau\b"),
    ("Power BI", r"\bpower\s*bi\b"),
    ("Automation", r"\bautomation\b"),
    ("Scripting", r"\bscripting\b"),
    ("ETL", r"\betl\b"),
    ("Java", r"\bjava\b"),
    ("C++", r"\bc\+\+\b"),
    ("C", r"\bc\b"),
    ("Go", r"\b(?:golang|go)\b"),
    ("Rust", r"\brust\b"),
    ("Scala", r"\bscala\b"),
    ("R", r"\br\b"),
    ("HTML", r"\bhtml\b"),
    ("CSS", r"\bcss\b"),
    ("Redis", r"\bredis\b"),
    ("Kafka", r"\bkafka\b"),
    ("Airflow", r"\bairflow\b"),
    ("Spark", r"\bspark\b"),
    ("Cloud", r"\bcloud\b"),
    ("Infrastructure", r"\binfrastructure\b"),
    ("Monitoring", r"\bmonitoring\b"),
    ("Logging", r"\blogging\b"),
]

# Words that never count as requirements.
STOP_WORDS = [
    "and", "the", "for", "with", "from", "that", "this", "have",
    "been", "were", "what", "when", "where", "which", "your",
    "their", "about", "into", "over", "after", "looking", "seeking",
    "role", "position", "team", "work", "experience", "years",
]

Lexicon = list[tuple[str, str]]


def word_forms(pattern: str) -> list[str] | None:
    """The words a pattern stands for, or None when it is more than a set of words."""
    if m := re.fullmatch(r"\\b([a-z0-9]+)\\b", pattern):
        return [m[1]]
    if m := re.fullmatch(r"\\b\(\?:([a-z0-9|]+)\)\\b", pattern):
        return m[1].split("|")
    if m := re.fullmatch(r"\\b([a-z0-9]+)\(\?:([a-z0-9]+)\)\?\\b", pattern):
        return [m[1], m[1] + m[2]]
    # An optional tail behind a non-word character cannot change whether the word occurs.
    if m := re.fullmatch(r"\\b([a-z0-9]+)\(\?:(?:\\\.|-)[a-z0-9]+\)\?\\b", pattern):
        return [m[1]]
    return None


def regex_for_spark(pattern: str) -> str:
    """Spell out word boundary and whitespace, whose built-in meanings are ASCII or too wide."""
    edge = f"(?:(?<={WORD_CLASS}){NO_WORD_AFTER}|{NO_WORD_BEFORE}(?={WORD_CLASS}))"
    body = re.sub(r"^\\b(?=[a-z0-9])", lambda _: NO_WORD_BEFORE, pattern)
    return body.replace(r"\b", edge).replace(r"\s", SPACE_CLASS)


def required_literal(pattern: str) -> str | None:
    """Leading literal that any match must contain."""
    m = re.match(r"\\b((?:[a-z0-9/]|\\[+.])+)", pattern)
    if not m:
        return None
    end = pattern[m.end():m.end() + 1]
    literal = re.sub(r"\\(.)", r"\1", m[1])
    return literal[:-1] if end in ("?", "*", "{") else literal


def with_skills(df: DataFrame, text: str, out: str, lexicon: Lexicon = SKILL_LEXICON) -> DataFrame:
    """Add ``out``: names of the lexicon skills found in ``text``, in lexicon order."""
    forms = {name: word_forms(pattern) for name, pattern in lexicon}
    known = sorted({w for words in forms.values() if words for w in words})
    folded, words = f"__{out}_folded", f"__{out}_words"
    df = df.withColumn(folded, fold_case(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(words, F.array_intersect(
        F.regexp_extract_all(F.col(folded), F.lit(WORD_PATTERN), F.lit(0)),
        F.array(*[F.lit(w) for w in known]) if known else F.array().cast("array<string>"),
    ))

    def hit(name: str, pattern: str) -> Column:
        if forms[name]:
            test = F.lit(False)
            for word in forms[name]:
                test = test | F.array_contains(words, word)
            return test
        test = F.col(folded).rlike(regex_for_spark(pattern))
        literal = required_literal(pattern)
        return F.contains(F.col(folded), F.lit(literal)) & test if literal else test

    found = F.array_compact(F.array(*[F.when(hit(n, p), F.lit(n)) for n, p in lexicon]))
    return settle(df, {out: found}, [c for c in df.columns if c not in (folded, words)])
