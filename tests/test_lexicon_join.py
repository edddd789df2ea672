"""A lexicon that comes as a table, against regular expressions one by one."""

import random
import re

from pyspark.sql import functions as F

from rolefold.functions.lexicon import with_skills
from rolefold.operators import lexicon_join as module
from rolefold.operators.lexicon_join import few_places, lexicon_join, phrases, word_list


def found(spark, texts, lexicon, patterned=False):
    frame = spark.createDataFrame([(*t, "p", "n") for t in texts], "id long, text string, phrase string, name string")
    table = spark.createDataFrame(lexicon, "name string, form string" + (", pattern string" if patterned else ""))
    return sorted((r["id"] if r["id"] is not None else -1, r["name"]) for r in lexicon_join(frame, table).collect())


def plain(texts, lexicon):
    out = set()
    for i, text in texts:
        for name, form in lexicon:
            words = (form or "").lower().split()
            if words and all(re.fullmatch(r"\w+", w) for w in words) and re.search(r"(?<!\w)" + r"\s+".join(words) + r"(?!\w)", (text or "").lower()):
                out.add((i if i is not None else -1, name))
    return sorted(out)


def test_forms_of_several_words(spark):
    random.seed(3)
    words = ["a", "b", "Rest", "api", "of", "x1", "naïve", "the", "the"]
    texts = [(i, "".join(random.choice(words) + random.choice([" ", " ", "  ", "\n", ", ", "-", ". ", "/"]) for _ in range(random.randint(0, 40)))) for i in range(80)]
    texts += [(None, "rest api"), (200, None), (201, ""), (202, "REST\tAPI"), (202, "the naïve"), (203, "the " * 20_000), (204, "rest\x01api")]
    lexicon = [(f"n{k}", " ".join(random.choice(words) for _ in range(random.randint(1, 4)))) for k in range(60)]
    lexicon += [("rest", "REST"), ("rest", "rest  api"), ("odd", "c++"), ("none", None), ("blank", " "), ("part", "ap"), ("the", "the")]
    assert found(spark, texts, lexicon) == plain(texts, lexicon)


def test_patterns_are_looked_at_where_their_form_occurs(spark):
    lexicon = [("C++", "c", r"(?<![a-z])c\+\+"), ("Node", "node", r"(?<![a-z])node(\.js)?(?![a-z])"), ("Go", "go", None)]
    texts = [(1, "C++ and node.js"), (2, "c and c#"), (3, "nodes go"), (4, "Node, go!"), (4, "C++"), (None, "c++"), (5, None)]
    assert found(spark, texts, lexicon, True) == [(-1, "C++"), (1, "C++"), (1, "Node"), (3, "Go"), (4, "C++"), (4, "Go"), (4, "Node")]


def test_same_as_the_expressions(spark):
    pairs = [("Python", "python"), ("In The", "in the"), ("REST", "rest")]
    texts = spark.createDataFrame([(1, "Python in  the REST"), (2, "pythonic, in, the"), (3, "rests")], "id long, text string")
    own = with_skills(texts, "text", "skills", [(n, r"\b" + f.replace(" ", r"\s+") + r"\b") for n, f in pairs])
    wanted = sorted((r["id"], s) for r in own.collect() for s in r["skills"])
    assert sorted(map(tuple, lexicon_join(texts, spark.createDataFrame(pairs, "name string, form string")).collect())) == wanted


def test_empty_sides(spark):
    none = spark.createDataFrame([], "name string, form string")
    texts = spark.createDataFrame([(1, "go")], "id long, text string")
    assert lexicon_join(texts, none).collect() == []
    assert lexicon_join(texts.limit(0), spark.createDataFrame([("Go", "go")], none.schema)).collect() == []


def test_a_longer_lexicon_costs_nothing_per_text(spark):
    """Phrases of the texts are made once, whatever the lexicon holds; it is only the other side of an equi-join."""
    texts = spark.createDataFrame([(1, "go rust")], "id long, text string")

    def plan(n):
        lexicon = spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("form"))
        return lexicon_join(texts, lexicon)._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(10).splitlines()) == len(plan(100_000).splitlines())
    assert "Join Inner, (phrase" in plan(10) and "RLIKE" not in plan(10)


def test_phrases_that_equal_no_form_are_not_made(spark):
    forms = spark.createDataFrame([("in the", 2), ("on a", 2), ("api", 1)], "phrase string, n int")
    texts = spark.createDataFrame([("the api in the on in a on the x in, the api",)], "text string")
    made = texts.select(phrases(word_list(F.col("text")), [1, 2], few_places(forms)).alias("made")).first()["made"]
    assert sorted(made) == ["api", "in a", "in the", "on the"]


def test_lexicons_of_few_and_of_many_words_find_the_same(spark, monkeypatch):
    random.seed(8)
    words = ["a", "b", "Rest", "api", "of", "x1", "naïve"]
    texts = [(i, "".join(random.choice(words) + random.choice([" ", " ", ", "]) for _ in range(random.randint(0, 30)))) for i in range(40)] + [(90, None), (91, " ")]
    lexicon = [(f"n{k}", " ".join(random.choice(words) for _ in range(random.randint(1, 3)))) for k in range(20)]
    few = found(spark, texts, lexicon)
    monkeypatch.setattr(module, "FEW_WORDS", 3)
    assert few == found(spark, texts, lexicon) == plain(texts, lexicon)
