"""Feed payloads and page snapshots, the source registry, and isolation of failing sources."""

import json

import pytest
from pyspark.sql import functions as F

from rolefold.catalog import collecting
from rolefold.session import run_dir
from rolefold.sources.cards import detail_text, guest_cards, split_heading, tuple_cards
from rolefold.functions.text import html_to_text
from rolefold.sources.feeds import feed_quarantine, flat_feed, nested_feed
from rolefold.sources.html import balanced_inner, joined_text
from rolefold.sources.registry import SOURCES, SourcesFailed, chosen_sources, collect_listings, read_feed, read_item_lines, read_payloads, source_listings
from rolefold.operators.filters import complete_card


def payloads(spark, *bodies):
    rows = [(str(i), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload_id string, body string")


def read(df):
    return [r.asDict() for r in df.orderBy("payload_id", "pos").collect()]


def test_nested_feed_fields(spark):
    (row,) = read(nested_feed(payloads(spark, {"jobs": [{
        "title": " Python Developer ", "companyName": "Acme", "minSalary": 120000, "maxSalary": 150000, "currency": "USD",
        "locationRestrictions": ["United States", "Canada"], "categories": ["software-engineering", "python"],
        "description": "<p>Python dev &amp; architect.</p>", "pubDate": 1756684800, "applicationLink": "https://a/b",
        "guid": "https://host/jobs/python-dev/"}]}), ["python"]))
    assert row["salary"] == "USD 120,000 - 150,000"
    assert row["location"] == "United States, Canada"
    assert row["job_id_on_platform"] == "python-dev"
    assert row["description"] == "Python dev & architect."
    assert row["skills"] == "software engineering, python"
    assert (row["title"], row["date_posted"], row["remote_level"]) == ("Python Developer", "2025-09-01", "Fully Remote")


def test_nested_feed_fallbacks(spark):
    rows = read(nested_feed(payloads(spark, {"jobs": [
        {"title": "Staff Backend Engineer", "companySlug": "startup-inc", "minSalary": 100000, "currency": "EUR", "pubDate": "2026-08-01T00:00"},
        {"title": "B", "maxSalary": 180000.7, "currency": "GBP", "locationRestrictions": []}, {"title": None}]})))
    assert rows[0]["url"].endswith("/companies/startup-inc/jobs/staff-backend-engineer")
    assert [r["salary"] for r in rows] == ["EUR 100,000+", "Up to GBP 180,000", "Not specified"]
    assert rows[0]["date_posted"] == "2026-08-01" and rows[1]["location"] == "Remote / Worldwide"
    assert rows[2]["job_id_on_platform"] is None  # filled from content by normalisation, the same on every run


def test_flat_feed(spark):
    rows = read(flat_feed(payloads(spark, {"jobs": [
        {"id": 101, "url": "https://r/101", "title": "Django Dev", "company_name": "B", "tags": ["python", "django", "aws"],
         "publication_date": "2026-08-28T10:00:00", "salary": "$140k - $180k", "description": "x", "salary_min": 1},
        {"id": 301, "title": "Go Dev", "tags": "python", "salary_min": 90000, "candidate_required_location": " EU "},
        {"id": 302, "title": "Rust Dev", "category": "Systems"}]}), ["PYTHON "]))
    assert [r["job_id_on_platform"] for r in rows] == ["101", "301"]
    assert (rows[0]["salary"], rows[0]["date_posted"], rows[0]["skills"]) == ("$140k - $180k", "2026-08-28", "python, django, aws")
    assert (rows[1]["salary"], rows[1]["location"], rows[1]["skills"]) == ("$90,000+", "EU", "python")


def test_bad_payloads_and_items_give_no_rows(spark):
    bodies = ["nonsense", "[1,2]", {"jobs": "x"}, {"jobs": None}, {}, {"jobs": [None, 1, "a", [2], {"title": "ok"}]}]
    for feed in (nested_feed, flat_feed):
        assert [r["title"] for r in read(feed(payloads(spark, *bodies)))] == ["ok"]


def test_whole_description_is_searched_and_kept(spark):
    body = {"jobs": [{"title": "t", "description": "x" * 4000 + " needle"}]}
    (row,) = read(nested_feed(payloads(spark, body), ["needle"]))
    assert len(row["description"]) == 4007
    (row,) = read(nested_feed(payloads(spark, body), ["needle"], description_limit=3000))
    assert len(row["description"]) == 3000


def test_large_bodies_give_all_items_and_bad_ones_a_reason(spark):
    items = F.transform(F.sequence(F.lit(1), F.lit(1400)), lambda i: F.to_json(F.struct(
        i.alias("id"), F.lit("t").alias("title"), F.repeat(F.lit("x"), 100_000).alias("description"))))
    large = spark.range(1).select(F.lit("large").alias("payload_id"), F.concat(
        F.lit('{"jobs":['), F.array_join(items, ","), F.lit("]}")).alias("body"))
    assert flat_feed(large).count() == 1400 and feed_quarantine(large).count() == 0
    bad = spark.createDataFrame([("a", '{"jobs":[{"title":"ok"},7,null,"text"]}'), ("b", '{"jobs":'), ("c", "[]"), ("d", None), ("e", '{"jobs":{}}')],
                                "payload_id string, body string")
    found = sorted((r["payload_id"], -1 if r["pos"] is None else r["pos"], r["reason"]) for r in feed_quarantine(bad).collect())
    none = "no list of jobs can be read"
    assert found == [("a", 1, "not an object"), ("a", 2, "cannot be read"), ("a", 3, "cannot be read"), ("b", -1, none), ("c", -1, none), ("d", -1, none),
                     ("e", -1, none)]
    assert [r["title"] for r in read(flat_feed(bad))] == ["ok"]


def test_many_references(values):
    import html
    text = "&eacute;&amp;&#233;&notit; &NotEqualTilde;&#x80;&bogus;& " * 300 + "<b>end</b>"
    assert values([text], html_to_text(F.col("x"))) == [" ".join(html.unescape(text).replace("<b>", " ").replace("</b>", " ").split())]


def page(spark, html):
    return spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")


CARD = """<ul class="jobs-search__results-list"><li><div class="base-card">
<h3 class="base-search-card__title">Senior Distributed Systems Lead</h3>
<h4 class="base-search-card__subtitle"><a href="#">Apex Dynamics</a></h4>
<span class="job-search-card__location">Remote, Worldwide</span>
<a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/senior-distributed-systems-lead-4091827364?trackingId=abc">Apply</a>
<time datetime="2026-08-29">1 day ago</time>
<span class="job-search-card__salary-info">$180,000 - $230,000</span></div></li></ul>"""


def test_guest_card(spark):
    details = spark.createDataFrame([(
        "https://www.linkedin.com/jobs/view/senior-distributed-systems-lead-4091827364",
        '<div class="a show-more-less-html__markup">Long <div>nested</div> text</div><div>no</div>')], "url string, html string")
    (row,) = guest_cards(page(spark, CARD), ["distributed"], details).collect()
    assert (row["title"], row["company"], row["location"]) == ("Senior Distributed Systems Lead", "Apex Dynamics", "Remote, Worldwide")
    assert (row["job_id_on_platform"], row["salary"], row["date_posted"]) == ("4091827364", "$180,000 - $230,000", "2026-08-29")
    assert (row["description"], row["skills"], row["remote_level"]) == ("Long nested text", "distributed", "Fully Remote")
    (row,) = guest_cards(page(spark, CARD.replace("<li>", "").replace("</li>", ""))).collect()
    assert row["description"] == "Senior Distributed Systems Lead at Apex Dynamics in Remote, Worldwide. Remote opportunities available."


def test_text_behind_a_card_does_not_belong_to_it(spark):
    bare = CARD.replace('<span class="job-search-card__salary-info">$180,000 - $230,000</span>', "")
    (row,) = guest_cards(page(spark, bare + '<p><span class="job-search-card__salary-info">$1</span></p>')).collect()
    assert row["salary"] == "Not specified"
    html = ('<div class="srp-jobtuple-wrapper" data-job-id="W"><div class="x"><a class="title" href="/a-123456">A</a></div></div>'
            '<span class="sal-wrap">9 Lacs</span><article class="jobTuple"><a class="title" href="/b-1234567?x=1">B</a><span class="sal-wrap"> 5 Lacs </span>'
            '</article><div class="tuple"><a class="title" href="">no link</a></div>')
    rows = tuple_cards(page(spark, html), ["go"]).orderBy("pos").collect()
    assert [(r["job_id_on_platform"], r["title"], r["salary"], r["company"], r["location"]) for r in rows] == [
        ("W", "A", "Not specified", "Naukri Recruiter", "India"), ("1234567", "B", "5 Lacs", "Naukri Recruiter", "India")]


def test_cards_without_required_fields_are_dropped(spark):
    html = '<li><h3 class="base-search-card__title">T</h3></li>' + CARD.replace("Apex Dynamics", " ")
    assert guest_cards(page(spark, html)).count() == 0
    cards = spark.createDataFrame([("a", "b", "c"), ("a", "", "c"), ("x" * 101, "b", "")], "title string, company string, url string")
    assert [complete_card(cards, rule).count() for rule in ("title+company+url", "title+company", "title+url", "short title")] == [1, 2, 2, 2]


def test_detail_containers_and_nesting(values):
    rows = ['<section class="show-more-less-html"><p>c</p></section>',
            '<div class="description__text"><div><div>a</div> b</div> &lt;i&gt;c</div><div>after</div>', "<p>none</p>"]
    assert values(rows, detail_text(F.col("x"))) == ["c", "a b c", None]
    assert values(["<div class='z'></div><div class=\"k m\">1<div>2</div>3</div>4"], balanced_inner(F.col("x"), "div", "m")) == [
        "1<div>2</div>3"]
    assert values(["<b> A </b> <i>B &amp; C</i>"], joined_text(F.col("x"))) == ["AB & C"]


def test_heading_split(values):
    rows = ["Acme - Lead - Go", "Acme | Lead", "Acme | Lead - Go", "Lead", ""]
    company, title = split_heading(F.col("x"), "Recruiter", "Engineer")
    assert values(rows, company, title) == [
        ("Acme", "Lead - Go"), ("Acme", "Lead"), ("Acme | Lead", "Go"), ("Recruiter", "Lead"), ("Recruiter", "Engineer")]


def test_source_selection():
    assert list(chosen_sources(None)) == list(chosen_sources([])) == list(SOURCES)
    assert list(chosen_sources(["Naukri", "Nowhere"])) == ["Naukri"]
    assert chosen_sources(["Nowhere"]) == {}


def test_limit_counts_matches_in_reading_order(spark):
    landed = payloads(spark, {"jobs": [{"title": f"{'go' if i % 2 else 'java'} {i}", "id": i + 1} for i in range(20)]},
                      {"jobs": [{"title": "go late", "id": 99}]})
    got = source_listings(landed, "Remotive", ["go"], 3)
    assert sorted(r["title"] for r in got.collect()) == ["go 1", "go 3", "go 5"]


def test_failing_source_leaves_the_others_alone(spark):
    good = payloads(spark, {"jobs": [{"title": "a", "id": 1}, {"title": "a2", "id": 1}, {"title": "b", "id": 2}]})

    def broken():
        raise OSError("unreachable")

    def breaks_while_running():
        return good.withColumn("body", F.raise_error(F.lit("corrupt")).cast("string"))

    found, errors = collect_listings({"Remotive": good, "Himalayas": broken, "Naukri": breaks_while_running}, spark)
    assert sorted(r["title"] for r in found.collect()) == ["a", "b"]
    assert [e.split(":")[0] for e in errors] == ["Himalayas", "Naukri"]
    nothing, errors = collect_listings({"Remotive": good}, spark, enabled=["Nowhere"])
    assert nothing.count() == 0 and errors == []


def test_a_failure_is_no_result(spark, monkeypatch):
    """Neither a whole with a source missing nor an empty table for sources that all failed."""
    good, bad = payloads(spark, {"jobs": [{"title": "a", "id": 1}, 7]}), spark.range(1)
    with pytest.raises(SourcesFailed, match="^Hirist: ") as raised:
        collect_listings({"Remotive": good, "Hirist": bad}, spark, whole=True)
    assert raised.value.__cause__ is not None
    with pytest.raises(SourcesFailed) as raised:
        collect_listings({"Hirist": bad, "Naukri": bad}, spark)
    assert [e.split(":")[0] for e in raised.value.errors] == ["Hirist", "Naukri"]
    with pytest.raises(SourcesFailed, match="Naukri: .*landed"):
        collect_listings({"Remotive": good}, spark, enabled=["Naukri", "Remotive"], whole=True)
    found, errors = collect_listings({"Remotive": good}, spark, enabled=["Naukri", "Remotive"])
    assert found.count() == 1 and [e.split(":")[0] for e in errors] == ["Naukri", "Remotive"]
    found, errors = collect_listings({"Remotive": good}, spark, whole=True)
    assert found.count() == 1 and errors == ["Remotive: 1 items cannot be read"]
    monkeypatch.setattr(collecting, "_nested_payloads", lambda spark, sf_dir: good)
    monkeypatch.setattr(collecting, "_link_pages", lambda spark, sf_dir: bad)
    monkeypatch.setattr(collecting, "_anchor_pages", lambda spark, sf_dir: page(spark, ""))
    with pytest.raises(SourcesFailed, match="Hirist"):
        collecting.collected_sources(spark, "")


def test_unreadable_items_are_counted_as_errors(spark):
    feed = payloads(spark, {"jobs": [{"title": "a", "id": 1}, 7, None, "x"]}, "{broken", {"jobs": []}, {"jobs": [{"title": "b", "id": 2}]})
    found, errors = collect_listings({"Remotive": feed, "Himalayas": feed.limit(0)}, spark)
    assert sorted(r["title"] for r in found.collect()) == ["a", "b"]
    assert errors == ["Remotive: 4 items cannot be read"]
    assert feed_quarantine(feed).count() == 4
    nothing, errors = collect_listings({"Remotive": payloads(spark, {"jobs": []})}, spark)
    assert nothing.count() == 0 and errors == []


def test_item_lines_are_read_in_blocks_and_in_order(spark, tmp_path):
    """A file of lines is read by many tasks; the first of equal keys is that of the first line, and a folder may hold both layouts."""
    lines = [json.dumps({"title": f"t{i}", "id": i // 2, "description": "words " * (i % 40)}) for i in range(4_000)]
    lines[10:10] = ["", "   ", "{broken", "[1]"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"jobs": [{"title": "last", "id": 9_999}, 5]}))
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        items = read_item_lines(spark, str(tmp_path))
        assert items.rdd.getNumPartitions() >= 8 and items.select("payload_id").distinct().count() >= 8
        assert [r["text"] for r in items.orderBy("payload_id", "pos").collect()] == [x for x in lines if x.strip()]
        assert sorted(r["reason"] for r in feed_quarantine(items).collect()) == ["cannot be read", "not an object"]
        both = read_feed(spark, str(tmp_path))
        found, errors = collect_listings({"Remotive": both}, spark)
        rows = {r["job_id_on_platform"]: r["title"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    # The number 0 is no id, so both of its items stay.
    assert len(rows) == 2_002 and all(rows[str(i)] == f"t{2 * i}" for i in range(1, 2_000)) and rows["9999"] == "last"
    assert errors == ["Remotive: 3 items cannot be read"]


def test_payload_files(spark):
    path = run_dir(spark, "payloads")
    spark.createDataFrame([('{"jobs":\n[{"title":"multi\\nline"}]}',)], "value string").coalesce(1).write.text(path)
    assert [r["title"] for r in read(nested_feed(read_payloads(spark, path)))] == ["multi\nline"]
