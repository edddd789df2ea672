"""Scores, reply parsing, résumé structure and tailoring, against plain Python where rules are involved."""

import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rolefold.functions.lexicon import SKILL_LEXICON, STOP_WORDS
from rolefold.operators.coverage import parse_replies, prompt_text, resume_profile, score_listings, score_pairs, token_coverage
from rolefold.operators.resume_text import SECTION_HEADERS, experience_entries, person_name, sections, skill_items, structure_resumes
from rolefold.operators.tailoring import best_bullets, rendered, tailor, top_bullets
from rolefold.functions.text import distinct_tokens
from rolefold.schemas import RESUME


def expected_score(listing, resume):
    """Independent statement of the scoring rules, sorted found-list included."""
    if not listing.strip() or not resume.strip():
        return 0, "No content provided to evaluate."
    named = [(n, p) for n, p in SKILL_LEXICON if re.search(p, listing, re.I)]
    if named:
        hits = [n for n, p in named if re.search(p, resume, re.I)]
        if hits:
            return int(len(hits) / len(named) * 100), f"Matched {len(hits)}/{len(named)} required skills. Found: {', '.join(hits[:8])}"
        return 0, f"Matched 0/{len(named)} required skills ({', '.join(n for n, _ in named[:5])})."
    wanted = set(re.findall(r"\b[a-z]{3,}\b", listing.lower())) - set(STOP_WORDS)
    if not wanted:
        return 0, "No recognizable skill keywords found in job description."
    hits = sorted(w for w in wanted if re.search(rf"\b{w}\b", resume, re.I))
    score = int(len(hits) / len(wanted) * 100)
    return score, (f"Matched {len(hits)}/{len(wanted)} general keywords. Found: {', '.join(hits[:8])}" if hits
                   else "No direct keyword matches found in resume.")


RESUME_TEXT = "Seasoned Python and SQL engineer. AWS, Docker; data\nscience. Coffee making, latte art and guarding."
LISTINGS = [
    "Python, SQL and Kafka on AWS", "We need Rust and Scala", "Barista: coffee, latte art, customers", "", "   ",
    "the and for with", "Data Science with Power BI", "gardening outdoors", "C++ and C on Linux", "a of it 12 345",
]


def scored(spark, listings, resume):
    df = spark.createDataFrame(list(enumerate(listings)), "id int, text string")
    profile = resume_profile(spark.createDataFrame([(resume,)], "text string"))
    return [(r["score"], r["reasoning"]) for r in score_listings(df, "id", "text", profile).orderBy("id").collect()]


def test_score_routing(spark):
    assert scored(spark, LISTINGS, RESUME_TEXT) == [expected_score(x, RESUME_TEXT) for x in LISTINGS]


def test_empty_resume_scores_nothing(spark):
    assert scored(spark, LISTINGS[:3], "  ") == [(0, "No content provided to evaluate.")] * 3


def test_resume_without_words_is_still_a_resume(spark):
    assert scored(spark, LISTINGS, "12 34 !") == [expected_score(x, "12 34 !") for x in LISTINGS]


WORDS = ["python", "latte", "art", "the", "Rust", "coffee", "x", "été", "guards", "role", "go", "sql", "data science", "café"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join), min_size=1, max_size=12),
       st.lists(st.sampled_from(WORDS), min_size=1, max_size=8).map(", ".join))
def test_scores_equal_python(spark, listings, resume):
    assert scored(spark, listings, resume) == [expected_score(x, resume) for x in listings]


def test_no_false_positive_between_trades(spark):
    assert scored(spark, ["Security guard for night shift with patrol duties"], "Barista skilled in espresso")[0][0] == 0


def test_ratio_is_cut_not_rounded(spark):
    listing = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    resume = " ".join(listing.split()[:29])
    assert scored(spark, [listing], resume)[0][0] == int(29 / 100 * 100)


def test_pair_scores(spark):
    rng = random.Random(3)
    listings = [(i, x) for i, x in enumerate(LISTINGS)]
    resumes = [(0, RESUME_TEXT), (1, "gardening and coffee"), (2, " ")]
    pairs = [(i, rng.randrange(3)) for i, _ in listings] + [(0, 1)]
    got = score_pairs(spark.createDataFrame(pairs, "listing_id int, resume_id int"),
                      spark.createDataFrame(listings, "listing_id int, text string"),
                      spark.createDataFrame(resumes, "resume_id int, text string")).collect()
    assert sorted((r[0], r[1], r["score"], r["reasoning"]) for r in got) == sorted(
        (a, b, *expected_score(LISTINGS[a], dict(resumes)[b])) for a, b in set(pairs))


def test_reply_parsing(spark):
    cases = {
        'Here: {"score": 88, "reasoning": "fit"} ok': (88, "fit"), '{"score": 140}': (100, ""), '{"score": -4.9}': (0, ""),
        '{"score": "77"}': (77, ""), '{"score": 64.9, "reasoning": "x\\ny"}': (64, "x\ny"), '{"reasoning": "none"}': (0, "none"),
        '{"score": "high"}': (11, "fallback"), '{"score": null}': (11, "fallback"), "no object": (11, "fallback"),
        '{"score": 5': (11, "fallback"), '{"score": 5,}': (11, "fallback"), '{"score": true}': (1, ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    got = {r["reply"]: (r["score"], r["reasoning"]) for r in parse_replies(df, "reply", F.lit(11), F.lit("fallback")).collect()}
    assert got == cases


def test_prompt_holds_both_texts(values):
    (text,) = values([("L" * 4000, "R" * 5000)], prompt_text(F.col("a"), F.col("b"), window=3000), schema="a string, b string")
    assert text.count("L" * 3000) == 1 and "L" * 3001 not in text and text.endswith("\n" + "R" * 3000)
    (text,) = values([("L" * 4000, "R" * 5000)], prompt_text(F.col("a"), F.col("b")), schema="a string, b string")
    assert text.count("L" * 4000) == 1 and text.endswith("\n" + "R" * 5000)


# -- résumé text ----------------------------------------------------------------------------

RESUME_PLAIN = """Ada Lovelace
ada@example.org | +1 555

SUMMARY:
Builds engines.

Work Experience
Analytical Co | Engineer | 2020-2024 | London
• Built pipelines
- Led team

EARLY WORK LTD
Assistant
* Counted | numbers

Skills
Python, SQL; Go | Rust
• Teaching · Writing
Education
Home
Skills
Only Python
Awards
References:
"""


def python_sections(text, headers):
    """The section rules once more: a running name and the lines since its header."""
    out, name, lines = {}, "header", []
    for raw in text.split("\n"):
        line = raw.strip()
        if line.lower().rstrip(":") in headers:
            if lines:
                out[name] = "\n".join(lines).strip()
            name, lines = line.lower().rstrip(":"), []
        else:
            lines.append(line)
    if lines:
        out[name] = "\n".join(lines).strip()
    return out


def test_sections_of_a_resume(values):
    (got,) = values([RESUME_PLAIN], sections(F.col("x")))
    named = {s["name"]: s["body"] for s in got}
    assert named == python_sections(RESUME_PLAIN, SECTION_HEADERS)
    assert named["skills"] == "Only Python" and "awards" not in named and named["references"] == ""


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["Skills", "skills::", " SUMMARY ", "text", "", "  ", "Education:", "more text"]),
                         max_size=12).map("\n".join), min_size=1, max_size=12))
def test_sections_equal_python(values, texts):
    for text, got in zip(texts, values(texts, sections(F.col("x")))):
        assert {s["name"]: s["body"] for s in got} == python_sections(text, SECTION_HEADERS), text


def test_experience_layouts(values):
    text = ("Analytical Co | Engineer | 2020 | London\n• Built\n\n- Led\nOther | Dev\nx\n"
            "EARLY WORK LTD\nAssistant\n* Counted | numbers\nmore\nLATER LTD\n\nno role here\nIBM\nFINAL WORDS | INC\n--\n")
    (got,) = values([text], experience_entries(F.col("x")))
    assert [(e["company"], e["role"], e["dates"], e["location"], e["bullets"]) for e in got] == [
        ("Analytical Co", "Engineer", "2020", "London", ["Built", "Led"]),
        ("Other", "Dev", "", "", ["x"]),
        ("EARLY WORK LTD", "Assistant", "", "", ["Counted | numbers", "more"]),
        ("LATER LTD", "", "", "", ["no role here", "IBM"]),
        ("FINAL WORDS", "INC", "", "", []),
    ]
    assert values(["", " \n "], F.size(experience_entries(F.col("x")))) == [0, 0]


def test_skill_items_and_name(values):
    assert values(["• Python, SQL; Go | Rust\n\n- Teaching · " + "x" * 50], skill_items(F.col("x"))) == [
        ["Python", "SQL", "Go", "Rust", "Teaching"]]
    assert values(["\n a@b.org\n" + "y" * 60 + "\n Ada \n", "me@x.org"], person_name(F.col("x"))) == ["Ada", None]


def test_structured_resume(spark):
    (row,) = structure_resumes(spark.createDataFrame([(RESUME_PLAIN,)], "text string")).collect()
    assert (row["name"], row["email"], row["summary"], row["education"]) == (
        "Ada Lovelace", "ada@example.org", "Builds engines.", "Home")
    assert row["skills"] == ["Only Python"] and row["certifications"] == []
    assert [e["company"] for e in row["experience"]] == ["Analytical Co", "EARLY WORK LTD"]


# -- tailoring ------------------------------------------------------------------------------

def test_best_bullets_keep_order_on_ties(values):
    bullets = ["alpha beta", "none", "beta gamma", "alpha", "zzz yyy", "alpha beta gamma"]
    got = values([(bullets, "Alpha BETA gamma!")], best_bullets(F.col("b"), distinct_tokens(F.col("d"))), schema="b array<string>, d string")
    assert got == [["alpha beta gamma", "alpha beta", "beta gamma", "alpha", "none"]]


def test_top_bullets_table_equals_row_form(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(r, p, " ".join(rng.choices(words, k=3))) for r in range(4) for p in range(rng.randrange(1, 40))]
    listings = spark.createDataFrame([(r, "alpha gamma" if r % 2 else "delta") for r in range(4)], "r int, d string").select(
        "r", distinct_tokens(F.col("d")).alias("words"))
    bullets = spark.createDataFrame(rows, "r int, pos int, text string")
    table = {r: [] for r in range(4)}
    for row in top_bullets(bullets, listings, ["r"]).orderBy("r", "rank").collect():
        table[row["r"]].append(row["text"])
    in_row = bullets.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("b")).join(listings, "r")
    for row in in_row.select("r", best_bullets(F.col("b.text"), F.col("words")).alias("x")).collect():
        assert row["x"] == table[row["r"]]


def resume_frame(spark):
    job = {"company": "Acme & Co", "role": "Dev", "dates": "2020", "location": "", "bullets": [f"line{i} python" if i > 4 else f"line{i}" for i in range(8)]}
    data = {"resume_id": "r", "name": "Ada <x>", "email": "a@b.org", "phone": None, "summary": "", "experience": [job],
            "skills": ["Python", "Cooking", "SQL-ish"], "education": "Home", "certifications": []}
    return spark.createDataFrame([data], RESUME)


def test_tailoring_one_listing_does_not_change_the_next(spark):
    listings = spark.createDataFrame(
        [(0, "Python Dev", "A", "python wanted"), (1, "Cook", "B", "line0 line1 cooking"), (2, "Other", "C", "zzz")],
        "id int, title string, company string, description string")
    both = listings.join(resume_frame(spark).withColumn("id", F.explode(F.array(*[F.lit(i) for i in range(3)]))), "id")
    rows = {r["id"]: r for r in tailor(both).collect()}
    assert rows[0]["experience"][0]["bullets"] == ["line5 python", "line6 python", "line7 python", "line0", "line1"]
    assert rows[1]["experience"][0]["bullets"] == ["line0", "line1", "line2", "line3", "line4"]
    assert rows[0]["skills"] == ["Python"] and rows[1]["skills"] == ["Cooking"]
    assert rows[2]["skills"] == ["Python", "Cooking", "SQL-ish"]
    assert rows[0]["summary"] == "Experienced professional seeking Python Dev role at A."


def test_rendered_page_escapes_and_skips_empty_blocks(spark):
    df = resume_frame(spark)
    (page,) = [r[0] for r in df.select(rendered(df)).collect()]
    assert "<h1>Ada &lt;x&gt;</h1>" in page and "Acme &amp; Co" in page and "<h2>Summary</h2>" not in page
    assert '<div class="contact">a@b.org</div>' in page and '<span class="skill">Cooking</span>' in page
    assert json.dumps(page)


def test_repeated_rows_are_scored_each(spark):
    resume = resume_profile(spark.createDataFrame([("alpha beta",)], "text string"), lexicon=[("Go", r"\bgo\b")])
    rows = [(1, "alpha gamma")] * 3 + [(1, "gamma delta")] + [(2, "go")] * 2 + [(None, None)] * 2 + [(3, "")] * 2 + [(4, "go beta"), (4, "alpha")]
    listings = spark.createDataFrame(rows, "id long, text string").repartition(3)
    scored = sorted((r.id or 0, r.score) for r in score_listings(listings, "id", "text", resume).collect())
    assert scored == [(0, 0)] * 2 + [(1, 0)] + [(1, 50)] * 3 + [(2, 0)] * 2 + [(3, 0)] * 2 + [(4, 0), (4, 100)]
    assert token_coverage(listings, "id", "text", resume).count() == len(rows)
