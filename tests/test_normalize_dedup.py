"""The listing contract, raw JSON input, keys, deduplication and top-n."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from rolefold.operators.dedup import first_per_page, first_wins, top_n
from rolefold.operators.normalize import normalize_listings, quarantine_json, raw_from_json
from rolefold.schemas import CONTRACT_FIELDS


def norm(spark, objects, **options):
    bodies = [(i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(bodies, "n int, body string")
    return [r.asDict() for r in normalize_listings(raw_from_json(df), **options).orderBy("n").collect()]


def test_empty_object_takes_all_defaults(spark):
    (row,) = norm(spark, [{}], default_platform="Himalayas")
    key = hashlib.sha256(b"himalayas:untitled position:unknown company:").hexdigest()[:16]
    assert row == {
        "n": 0, "job_id_on_platform": key, "platform": "Himalayas", "title": "Untitled Position", "company": "Unknown Company",
        "location": "Remote", "url": "", "description": "", "salary": None, "date_posted": None, "skills": None,
        "salary_range": "Not specified", "remote_level": "Remote", "skills_required": ""}
    assert set(row) == {"n", *CONTRACT_FIELDS}


def test_nulls_blanks_and_long_text(spark):
    (row,) = norm(spark, [{"platform": None, "company": "   ", "description": "A" * 5000, "date_posted": "  2026-08-30  ",
                           "skills": ["Python", None, 123, "DuckDB"], "location": None, "remote_level": "EU"}])
    assert (row["company"], len(row["description"]), row["date_posted"], row["skills"], row["location"]) == (
        "Unknown Company", 5000, "2026-08-30", "Python, 123, DuckDB", "EU")


def test_description_limit_on_request(spark):
    (row,) = norm(spark, [{"description": "A" * 5000}], description_limit=3000)
    assert len(row["description"]) == 3000


def test_blank_platform_is_unknown_not_the_default(spark):
    rows = norm(spark, [{"platform": "   "}, {"platform": ""}, {"platform": None}], default_platform="Remotive")
    assert [r["platform"] for r in rows] == ["Unknown", "Remotive", "Remotive"]


def test_non_text_values_keep_their_json_text(spark):
    (row,) = norm(spark, [{"job_id_on_platform": 987654321, "title": 404, "company": {"k": "v"}, "url": False,
                           "skills": ["Python", 123, True, None, "Docker"]}])
    assert (row["job_id_on_platform"], row["title"], row["company"], row["url"], row["skills"]) == (
        "987654321", "404", '{"k":"v"}', "", "Python, 123, true, Docker")


def test_falsy_values_fall_through(spark):
    rows = norm(spark, [{"title": 0, "salary": "", "salary_range": "$5"}, {"salary": None, "salary_range": ""},
                        {"salary": "Not specified"}, {"skills": [], "skills_required": "a, b"}])
    assert (rows[0]["title"], rows[0]["salary"]) == ("Untitled Position", "$5")
    assert (rows[1]["salary"], rows[1]["salary_range"]) == (None, "Not specified")
    assert (rows[2]["salary"], rows[2]["salary_range"]) == (None, "Not specified")
    assert rows[3]["skills"] == "a, b"


def test_unicode_is_kept_and_hashed(spark):
    (row,) = norm(spark, [{"title": "Développeur 🚀 工程师", "company": "Überfirma", "url": "https://x/é"}], default_platform="P")
    seed = "p:développeur 🚀 工程师:überfirma:https://x/é"
    assert row["job_id_on_platform"] == hashlib.sha256(seed.encode()).hexdigest()[:16]
    assert row["title"] == "Développeur 🚀 工程师"


def test_both_key_orders(spark):
    raw = {"platform": "P", "title": "T", "company": "C", "url": "U", "job_id_on_platform": "  "}
    assert norm(spark, [raw])[0]["job_id_on_platform"] == hashlib.sha256(b"p:t:c:u").hexdigest()[:16]
    assert norm(spark, [raw], company_first_key=True)[0]["job_id_on_platform"] == hashlib.sha256(b"p:c:t:u").hexdigest()[:16]


def test_only_objects_are_listings_and_the_rest_is_quarantined(spark):
    bad = ["null", '"text"', "12", "[1]", "true", "{broken", "NaN"]
    df = spark.createDataFrame([(b,) for b in [*bad, '{"title":"ok"}']], "body string")
    assert [r["title"] for r in raw_from_json(df).collect()] == ["ok"]
    assert sorted(r["body"] for r in quarantine_json(df).collect()) == sorted(bad)


def test_keys_do_not_collide(spark):
    df = spark.range(5000).select(F.format_string("Role %d", "id").alias("title"), F.lit("C").alias("company"))
    assert normalize_listings(df).select("job_id_on_platform").distinct().count() == 5000


def listing(platform, key, n):
    return (platform, key, n)


def test_first_wins_ignores_case_and_padding(spark):
    rows = [("LinkedIn", "1", 0), ("linkedin ", " 1 ", 1), ("Naukri", "1", 2), ("LinkedIn", "2", 3), ("LINKEDIN", "2", 4)]
    df = spark.createDataFrame(rows, "platform string, job_id_on_platform string, n int")
    assert sorted(r["n"] for r in first_wins(df, ["n"]).collect()) == [0, 2, 3]


def test_first_wins_does_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "A", "b"]), str(rng.choice([0, 0, 0, rng.randrange(50)])), n) for n in range(600)]
    expected = {}
    for platform, key, n in rows:
        expected.setdefault((platform.lower(), key), n)
    df = spark.createDataFrame(rows, "platform string, job_id_on_platform string, n int")
    for parts in (1, 7):
        got = first_wins(df.repartition(parts, F.rand(parts)), ["n"])
        assert sorted(r["n"] for r in got.collect()) == sorted(expected.values())


def test_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 g", "id")
    plan = top_n(df, ["g"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_first_per_page(spark):
    df = spark.createDataFrame([(1, "u", 0), (1, "u", 1), (2, "u", 5), (1, "v", 2)], "page_id int, url string, pos int")
    assert sorted((r["page_id"], r["url"], r["pos"]) for r in first_per_page(df, "page_id", "url", ["pos"]).collect()) == [
        (1, "u", 0), (1, "v", 2), (2, "u", 5)]
