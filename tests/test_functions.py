"""Scalar expressions against the values they must give, and against plain Python."""

import html
import html.entities
import random
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rolefold.functions.entities import unescape
from rolefold.functions import stages, text, values as nums
from rolefold.functions.lexicon import SKILL_LEXICON, word_forms, with_skills
from rolefold.functions.rows import settle

X = F.col("x")
ANY_TEXT = st.lists(st.text(alphabet=st.sampled_from(list("aZ9_- \t\n  \x1cé́ß€<>&;#|+./cCrRgGoOİıſK'\"")), max_size=30),
                    min_size=1, max_size=20)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(ANY_TEXT)
def test_strip_and_tokens_equal_python(values, rows):
    got = values(rows, text.strip(X), text.tokens(X), text.collapse_spaces(X))
    for raw, (stripped, tokens, collapsed) in zip(rows, got):
        assert stripped == raw.strip()
        assert tokens == re.findall(r"\b[a-zA-Z]{3,}\b", raw.lower())
        assert collapsed == re.sub(r"\s+", " ", raw).strip()


@FEW
@given(st.lists(st.lists(st.sampled_from(
    ["python", "C++", "c++x", "C", "golang", "Go", "react.js", "REACT", "node", "rest", "restful", "RESTless", "data  science",
     "data science", "power BI", "powerbi", "ci/cd", "scikit-learn", "scikit", "r", "R&D", "éc", "ſcala", "Kafka", "_sql", "sql_", " ", ",", ".", "\n"]),
    max_size=12).map("".join), min_size=1, max_size=15))
def test_skill_scan_equals_python_regex(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    got = [r["s"] for r in with_skills(df, "x", "s").select("s").collect()]
    for raw, found in zip(rows, got):
        assert found == [n for n, p in SKILL_LEXICON if re.search(p, raw, re.IGNORECASE)], raw


def test_lexicon_shape():
    assert len(SKILL_LEXICON) == 63
    assert [n for n, p in SKILL_LEXICON if word_forms(p) is None] == [
        "Data Science", "Machine Learning", "Deep Learning", "Artificial Intelligence", "CI/CD", "Power BI", "C++"]


def test_html_text(values):
    rows = ["<p>Python dev &amp; architect.</p>", "Experience with &quot;React&quot; &#39;Node&#39; &amp; Python.",
            "&lt;b&gt;gone&lt;/b&gt; kept", "a&nbsp;&nbsp;b<br/>c", "&amp;lt;", "", None]
    assert values(rows, text.html_to_text(X)) == [
        "Python dev & architect.", "Experience with \"React\" 'Node' & Python.", "gone kept", "a b c", "&lt;", "", ""]


@FEW
@given(st.lists(st.lists(st.one_of(
    st.sampled_from(["&eacute;", "&hellip", "&notit;", "&not", "&amp;", "&amp", "&lt;", "&AMP;x", "&nbsp;", "&bogus;", "&", "&;", "&#", "&#;", "&#x;",
                     "&#x2019;", "&#8364", "&#128;", "&#159;", "&#129;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x1F680;", "&#11;",
                     "&#65534;", "&NotEqualTilde;", "&copy2;", "&apos;", "#", ";", "a", " ", "&#13;", "&#x10FFFF;"]),
    st.integers(0, 0x110010).map(lambda n: f"&#{n};"), st.integers(0, 0x3000).map(lambda n: f"&#x{n:x}"),
    st.sampled_from(sorted(html.entities.html5)).map(lambda n: "&" + n)), max_size=8).map("".join), min_size=1, max_size=25))
def test_unescape_equals_python(values, rows):
    for raw, got in zip(rows, values(rows, unescape(X))):
        assert got == html.unescape(raw), raw


def test_slugs(values):
    assert values(["C++ / Rust Developer!", "   Machine   Learning   ", "Python Backend"], text.keyword_slug(X, "-jobs")) == [
        "c-rust-developer-jobs", "machine-learning-jobs", "python-backend-jobs"]
    assert values(["AI / ML Researcher", "Full Stack Engineer"], text.keyword_slug(X)) == [
        "ai-ml-researcher", "full-stack-engineer"]
    assert values(["Staff Backend Engineer", "(C#) Dev!"], text.title_slug(X)) == ["staff-backend-engineer", "c-dev"]


def test_url_ids(values):
    linked = ["https://h/jobs/view/4019283746", "https://h/jobs/view/staff-engineer-4019283746?refId=1",
              "https://h/jobs/search/?currentJobId=4019283746-1234567", "https://h/unknown/path", ""]
    assert values(linked, text.url_id(X, "LinkedIn")) == ["4019283746", "4019283746", "1234567", None, None]
    assert values(["http://h/job-listings-python-dev-12345678?src=srp", "http://h/other"], text.url_id(X, "Naukri")) == ["12345678", None]
    assert values(["https://h/jobs/9876543-lead-engineer", "https://h/jobs/"], text.url_id(X, "Wellfound")) == ["9876543", None]
    assert values(["https://h/j/backend-engineer-54321.html", "https://h/j/invalid.html"], text.url_id(X, "Hirist")) == ["54321", None]
    assert values(["https://host/jobs/python-dev/", "abc"], text.last_segment(X)) == ["python-dev", "abc"]


def test_salary_shapes(values):
    rows = [(120000.0, 150000.0, "USD"), (100000.9, None, "EUR"), (None, 180000.0, "GBP"), (None, None, None),
            (0.0, 90000.0, None), (0.0, 0.0, "")]
    schema = "a double, b double, c string"
    assert values(rows, nums.salary_with_currency(F.col("a"), F.col("b"), F.col("c")), schema=schema) == [
        "USD 120,000 - 150,000", "EUR 100,000+", "Up to GBP 180,000", "Not specified", "Up to USD 90,000", "Not specified"]
    rows = [(120000.0, 160000.0, None), (90000.0, None, " "), (1.0, 2.0, "$140k - $180k"), (None, 7000.0, "")]
    assert values(rows, nums.salary_in_dollars(F.col("c"), F.col("a"), F.col("b")), schema=schema) == [
        "$120,000 - $160,000", "$90,000+", "$140k - $180k", "Up to $7,000"]


def test_dates(values):
    assert values([0, 1756684800], nums.date_from_epoch(X), schema="x bigint") == [None, "2025-09-01"]
    assert values(["2026-08-28T10:00:00", "2026-08-28 10:00", "", None], nums.date_before_t(X)) == [
        "2026-08-28", "2026-08-28", None, None]
    assert values(["2026-08-28T10:00:00", ""], nums.date_prefix(X)) == ["2026-08-28", None]
    parsed = values(["2026-09-05 14:00", "2026-09-05", "2026", "2026-09", "soon", None, "2026-13-45"],
                    F.date_format(nums.tolerant_timestamp(X), "yyyy-MM-dd HH:mm"))
    assert parsed == ["2026-09-05 14:00", "2026-09-05 00:00", None, None, None, None, None]


def test_whole_numbers(values):
    assert values([95.0, 88.9, -3.7, None, float("nan"), float("inf")], nums.whole_number(X), schema="x double") == [
        95, 88, -3, None, None, None]
    assert values([" 88 ", "88.5", "invalid", "", None, "+7", "1_000"], nums.whole_number(X, "string")) == [
        88, None, None, None, None, 7, 1000]


def test_stages_and_bands(values):
    rows = ["ready", "READY", "Applied", "applied", "Offer", "offer", "nonsense", "", None]
    assert values(rows, stages.canonical_stage(X)) == [
        "Ready to Apply", "Ready to Apply", "Applied", "Applied", "Offer", "Ready to Apply", "Ready to Apply", "Ready to Apply",
        "Ready to Apply"]
    assert values(["Ready to Apply", "ready", "Applied", "Custom"], stages.job_status(X)) == ["ready", "ready", "applied", "custom"]
    assert values(["Rejected", "Offer", "Applied", "other"], stages.next_stage(X)) == [
        "Ready to Apply", "Offer", "Reply Received", "other"]
    assert values([None, 80, 79, 60, 59], stages.score_band(X), schema="x int") == ["Unevaluated", "high", "mid", "mid", "low"]
    assert values([None, " Ready ", "ready to apply", "Applied", ""], stages.is_past_ready(X)) == [True, False, False, True, True]


def test_escape_and_keywords(values):
    assert values(["<a href=\"x\">'&'</a>"], text.html_escape(X)) == [html.escape("<a href=\"x\">'&'</a>")]
    assert text.split_keywords(" Python, ,Data Engineer ") == ["python", "data engineer"]
    assert text.split_keywords(None) == []
    assert values([" a, ,b ,"], text.keyword_list(X)) == [["a", "b"]]
    assert values(["Python dev"], text.contains_any(F.lower(X), ["PYTHON"]), text.contains_any(F.lower(X), ["go"]),
                  text.contains_any(F.lower(X), [])) == [(True, False, True)]
    assert values(["a@b.org, c@d.org", "none"], text.email(X)) == ["a@b.org", None]


def test_settled_columns_are_not_copied_into_filters(spark):
    df = settle(spark.range(10).selectExpr("cast(id as string) s"), {"h": F.sha2("s", 256)}).filter("h > 'a' and h < 'b'")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1


def test_spaces_and_case_of_every_kind(values):
    kinds = [*text.WHITESPACE, *" \n\t", "a", "ſ", "İ", "ı", "K", "é", "\u200b"]
    random.seed(5)
    rows = ["".join(random.choice(kinds) for _ in range(random.randint(0, 12))) for _ in range(400)] + [None]
    for row, (spaces, folded) in zip(rows, values(rows, text.collapse_spaces(F.col("x")), text.fold_case(F.col("x")))):
        assert spaces == (None if row is None else " ".join(row.split()))
        assert folded == (None if row is None else row.translate(str.maketrans("İıſK", "iisk")).lower())
