"""Queries of the package and its pipeline on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from rolefold.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.dtypes == docs.dtypes, name
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    quality, lines, near, _ = counts[1:]
    assert counts[0] > quality == lines > near > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == docs.count() and last.where("n_tokens = 0").count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, site string"
    text = "this document has more than ten different words in it, so it is kept by all rules"
    rows = [(1, text, None, "a", 5, 0, "r", "s"), (1, text, None, "a", 5, 0, "r", "s"), (2, None, None, None, None, None, None, None),
            (None, text + " as well and again", "en", None, None, 1, "r", "s"), (3, "", "en", "b", 0, 1, "r", "s")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF_DIR)
            rows_out = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(rows_out, schema)
        assert (len(rows_out) > 0) == bool(given)


def test_a_group_with_a_third_of_a_source_keeps_one_text(spark):
    """Copies, equal or nearly so, are not boilerplate of their source: the first one stays whole."""
    shared = [f"line {k} of a text that many rows of this source have" for k in range(30)]
    rows = [(100 + i, "\n".join(shared), "a") for i in range(10)]
    rows += [(200 + i, "\n".join([*(f"{line} too" for line in shared), f"copy {i}"]), "a") for i in range(10)]
    rows += [(i, f"menu\nown text {i} with words {i * i} of its own", "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = corpus_pipeline.lines(spark, docs, SF_DIR)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    given = {i: text for i, text, _ in rows}
    assert texts[100] == given[100] and texts[200] == given[200]
    assert [i for i in range(30) if "menu" in texts[i]] == [0]
    assert sorted({line for t in texts.values() for line in t.split("\n") if line}) == sorted({line for t in given.values() for line in t.split("\n")})
    stay = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, cleaned, SF_DIR).where("text != ''").collect()]
    assert 100 in stay and 200 in stay and not set(stay) & set(range(101, 110))
