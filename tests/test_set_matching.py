"""The best listings of every résumé against all pairs scored one by one."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolefold.functions.lexicon import STOP_WORDS
from rolefold.operators import set_matching
from rolefold.operators.set_matching import best_listings, candidate_pairs

LEXICON = [("Go", r"\bgo\b"), ("Rust", r"\brust\b")]
LISTINGS, RESUMES = "listing_id long, text string, key string, rank int, terms string", "resume_id long, text string, key string, n int"


def words(text):
    return {w for w in (text or "").lower().split() if len(w) > 2}


def skills(text):
    return {"+" + w for w in (text or "").lower().split() if w in ("go", "rust")}


def plain(listings, resumes, k, min_score):
    offered = collections.defaultdict(set)
    for i, text in resumes:
        offered[i] |= words(text) | skills(text)
    out = []
    for i, terms in offered.items():
        found = []
        for j, text in listings:
            asked = skills(text) or words(text) - set(STOP_WORDS)
            if asked and int(len(asked & terms) / len(asked) * 100) >= min_score:
                found.append((-int(len(asked & terms) / len(asked) * 100), -len(asked & terms), j, len(asked)))
        out += [(i, r + 1, j, -s, -o, n) for r, (s, o, j, n) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]

    def text(n):
        # Low numbers are frequent; "hot" is everywhere.
        return " ".join([vocabulary[min(int(random.expovariate(0.08)), 59)] for _ in range(n)] + ["hot"] * random.randint(0, 1))

    listings = [(i, text(random.randint(1, 14))) for i in range(120)]
    listings += [(200 + i, "hot waa wab") for i in range(40)] + [(300, None), (301, ""), (302, "the and for"), (303, "we use go"), (304, "go and rust"), (305, "hot")]
    listings += [(306, " ".join(vocabulary))] + [(307, "waa hot")] * 2
    resumes = [(i, text(random.randint(1, 40))) for i in range(40) for _ in range(1 + i % 2)]
    resumes += [(60 + i, "hot waa wab wac") for i in range(20)] + [(90, None), (91, ""), (92, "go waa"), (93, "unknown terms only"), (94, " ".join(vocabulary))]
    return listings, resumes


@pytest.mark.parametrize("k,min_score", [(10, 70), (3, 34), (10, 1), (2, 100), (1000, 50)])
def test_best_listings(spark, k, min_score):
    listings, resumes = corpus(min_score)
    out = best_listings(spark.createDataFrame([(*r, "k", 1, "t") for r in listings], LISTINGS).repartition(3),
                        spark.createDataFrame([(*r, "k", 1) for r in resumes], RESUMES).repartition(2), k, min_score, LEXICON)
    assert sorted((r.resume_id, r.rank, r.listing_id, r.score, r.n_matched, r.n_required) for r in out.collect()) == plain(listings, resumes, k, min_score)


def test_empty_tables(spark):
    listings, resumes = spark.createDataFrame([], LISTINGS), spark.createDataFrame([(1, "go")], "resume_id long, text string")
    assert best_listings(listings, resumes).collect() == []
    assert best_listings(spark.createDataFrame([(1, "go")], "listing_id long, text string"), resumes.limit(0)).collect() == []
    with pytest.raises(ValueError):
        best_listings(listings, resumes, min_score=0)


def test_a_term_of_all_rows_does_not_grow_the_join(spark):
    """Every set gets one more term that all have; it is in no prefix, so no further rows meet."""
    def ranks(sets, more):
        top = 10_000
        rows = [(str(i), sorted(s) + ([top] if more else [])) for i, s in enumerate(sets)]
        return spark.createDataFrame(rows, "key string, ranks array<long>")

    random.seed(4)
    asked, offered = ([random.sample(range(3000), 12) for _ in range(300)] for _ in range(2))

    def joined(more):
        plan = candidate_pairs(ranks(asked, more), ranks(offered, more), 70)
        prefix = ranks(asked, more).select(F.explode(F.slice("ranks", F.lit(1), F.size("ranks") - F.ceil(F.size("ranks") * 0.7).cast("int") + 1)).alias("rank"))
        assert prefix.where("rank = 10000").isEmpty()
        return plan.count(), prefix.join(ranks(offered, more).select(F.explode("ranks").alias("rank")), "rank").count()

    few, many = joined(False), joined(True)
    assert many[1] <= few[1] * 1.1 + 10 and many[0] <= few[0] + 5


def test_no_cross_join(spark):
    listings, resumes = corpus(1)
    plan = best_listings(spark.createDataFrame(listings, "listing_id long, text string"), spark.createDataFrame(resumes, "resume_id long, text string"),
                         lexicon=LEXICON)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join Inner" in plan and set_matching


def test_frequent_terms_make_no_pairs_that_cannot_reach_the_score(spark):
    """All sets share their rarest term and nothing else: each pair met before, and none of them counts."""
    def sets(side):
        return spark.createDataFrame([(f"{side}{i}", [0, *range(1 + (2 * i + side) * 9, 10 + (2 * i + side) * 9)]) for i in range(60)], "key string, ranks array<long>")

    assert candidate_pairs(sets(0), sets(1), 20).count() == 0
    assert candidate_pairs(sets(0), sets(1), 10).count() == 3600


@pytest.mark.parametrize("step,k", [(4_000_000, None), (500, None), (50, 3), (1, 2)])
def test_cells_against_all_pairs(monkeypatch, step, k):
    """Whatever a cell looks at together, it finds the pairs that reach each résumé's own least score; some terms have no rank."""
    monkeypatch.setattr(set_matching, "STEP", step)
    random.seed(step)
    near = sorted(random.sample(range(90), 40))
    asked = {i: sorted(random.sample(range(90), random.choice([1, 2, 3, 8, 40]))) for i in range(70)} | {70 + i: sorted(set(near) ^ {i}) for i in range(20)}
    offered = {i: (sorted(random.sample(range(90), random.randint(1, 60))), random.choice([1, 30, 67, 100])) for i in range(40)} | {40 + i: (near, 20 * i + 20) for i in range(5)}
    n = {i: len(s) + i % 3 for i, s in asked.items()}
    shuffled = random.sample(list(asked), len(asked))
    out = set_matching._cell(
        pa.table({"key": shuffled, "n": [n[i] for i in shuffled], "ranks": pa.array([asked[i] for i in shuffled], pa.list_(pa.int32()))}),
        pa.table({"key": list(offered), "least_score": [t for _, t in offered.values()], "ranks": pa.array([s for s, _ in offered.values()], pa.list_(pa.int32()))}), k)
    wanted = []
    for j, (terms, least) in offered.items():
        scored = sorted((-int(len(set(s) & set(terms)) / n[i] * 100), -len(set(s) & set(terms)), i) for i, s in asked.items())
        wanted += [(i, j, -o, n[i]) for score, o, i in scored if -score >= least][:k]
    found = list(zip(*(out[c].to_pylist() for c in ("asked_key", "offered_key", "n_matched", "n_required"))))
    assert len(set(found)) == len(found) and set(found) >= set(wanted)
    if k is None:
        assert sorted(found) == sorted(wanted)


def test_a_set_is_written_once_whatever_the_cells(spark, monkeypatch):
    """No exchange copies sets for the cells, and all cells together find what a single one finds."""
    random.seed(6)
    asked, offered = ([(i + 100 * side, sorted(random.sample(range(300), random.choice([1, 5, 30])))) for i in range(80)] for side in (0, 1))
    asked = spark.createDataFrame(asked, "key long, ranks array<int>").withColumn("n", F.size("ranks")).repartition(5)
    offered = spark.createDataFrame(offered, "key long, ranks array<int>").withColumn("least_score", F.lit(30)).repartition(3)
    paths, name_of = [], set_matching.run_dir
    monkeypatch.setattr(set_matching, "run_dir", lambda spark, name: paths.append(name_of(spark, name)) or paths[-1])

    def found():
        out = set_matching.meetings(asked, offered)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, out.collect()))

    single = found()
    monkeypatch.setattr(set_matching, "ASKED_TERMS", 100)
    monkeypatch.setattr(set_matching, "OFFERED_TERMS", 200)
    paths.clear()
    assert found() == single and len(single) > 100
    for side, sets, most in (("asked", asked, 100), ("offered", offered, 200)):
        (path,) = [x for x in paths if f"{side}-parts" in x]
        parts = spark.read.parquet(path).select((F.octet_length(f"{side}_ranks") / 4).alias("n"), F.size(f"{side}_key").alias("sets"))
        assert parts.count() > 3 and parts.where(F.col("n") > most).isEmpty()
        total = parts.agg(F.sum("n"), F.sum("sets")).first()
        assert tuple(total) == (sets.agg(F.sum(F.size("ranks"))).first()[0], 80)


def test_parts_are_filled_up_and_a_large_set_is_one_of_its_own():
    batches = [pa.RecordBatch.from_arrays([pa.array(keys), pa.array([7] * len(keys), pa.int32()), pa.array([list(range(s)) for s in sizes], pa.list_(pa.int32()))],
                                          ["key", "number", "ranks"]) for keys, sizes in (([1, 2, 3], [4, 6, 1]), ([], []), ([4, 5, 6], [25, 0, 9]))]
    assert [x.column(0)[0].as_py() for x in set_matching._pack(iter(batches), 10)] == [[1, 2], [3], [4], [5, 6]]
    assert list(set_matching._pack(iter([]), 10)) == []


@pytest.mark.parametrize("end", [3, 50, 10_000])
def test_counted(end):
    numbers = [random.Random(end).randrange(end) for _ in range(40)]
    for some in (numbers, []):
        found, times = set_matching._counted(np.array(some, np.int64), end)
        assert dict(zip(found.tolist(), times.tolist())) == collections.Counter(some) and sorted(found.tolist()) == found.tolist()
