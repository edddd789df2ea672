"""The best listings of every résumé, by a set-overlap join with prefix filter.

A listing asks for a set of terms: the skills it names, or its words where it names none. A résumé offers skills and words. The score is the part of the asked terms
that is offered, as in ``coverage``. Of n terms m must be offered for the least score; whoever offers m of them offers 1 + m // 4 of the n - m + 1 + m // 4 rarest. Only these
prefixes are looked up, and the few pairs that have so many of them in common are compared in full.

The listings that ask for least come first: they give every résumé ``k`` listings of some score, and of all other listings only those are looked for that reach it.

Pairs are looked for in cells, each a part of the listings and a part of the résumés: what is looked up stays in the task, and only a cell's best pairs leave it.
A part is one row of a table that is written once. The tasks of all cells read it from there, so nothing is copied for a cell, on disk or in a shuffle.
Listings that ask for the same set are one class, of which only the first ``k`` ids can be among the best; résumés that offer the same set are one class as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lexicon import SKILL_LEXICON, Lexicon, with_skills
from ..functions.rows import settle
from ..functions.text import distinct_tokens
from ..session import materialise, run_dir
from .coverage import required_tokens, share
from .ordering import with_position

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

ASKED_TERMS, OFFERED_TERMS = 4_000_000, 8_000_000     # of a cell, at most, but for a single set; a task holds some 80 bytes for each asked term
CELLS = 24              # at least, so that all cores have work, as far as a part has
LEAST_TERMS = 20_000    # terms
STEP = 4_000_000        # numbers that a cell looks at together
FIRST_SHARE = 0.05      # of the classes of listings, those that ask for least; any share gives the same rows


def _marked(skills: Column) -> Column:
    """Skills apart from words, which consist of letters alone."""
    return F.transform(skills, lambda s: F.concat(F.lit("+"), s))


def asked_terms(listings: DataFrame, lexicon: Lexicon = SKILL_LEXICON) -> DataFrame:
    """(listing_id, terms) of listings that ask for anything."""
    found = with_skills(listings.select("listing_id", "text"), "text", "skills", lexicon)
    words = required_tokens(F.coalesce(F.col("text"), F.lit("")))
    terms = F.when(F.size("skills") > 0, _marked(F.col("skills"))).otherwise(words)
    return settle(found, {"terms": F.sort_array(terms)}, ["listing_id"]).where(F.size("terms") > 0)


def offered_terms(resumes: DataFrame, lexicon: Lexicon = SKILL_LEXICON) -> DataFrame:
    """Distinct (resume_id, term); a résumé may come as any number of passages, each read on its own."""
    found = with_skills(resumes.select("resume_id", "text"), "text", "skills", lexicon)
    words = distinct_tokens(F.coalesce(F.col("text"), F.lit("")))
    return found.select("resume_id", F.explode(F.concat(_marked(F.col("skills")), words)).alias("term")).distinct()


def _classes(sets: DataFrame, members: str) -> DataFrame:
    """``sets`` with a key that equal sets share."""
    return sets.withColumn("key", F.md5(F.array_join(F.col(members).cast("array<string>"), " ").cast("binary")))


def _pieces(cost: np.ndarray) -> Iterator[slice]:
    """Slices of consecutive items that cost ``STEP`` together, or about that."""
    import numpy as np
    group = np.cumsum(cost) // STEP
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    return (slice(a, b) for a, b in zip(np.append(0, ends[:-1]), ends) if b > a)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1``, … of every run, one run after the other."""
    import numpy as np
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _counted(numbers: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers from 0 to ``end`` and how often each occurs."""
    import numpy as np
    if end <= 2 * len(numbers):
        times = np.bincount(numbers, minlength=end)
        found = np.flatnonzero(times)
        return found, times[found]
    # Few of the possible numbers occur: a sort is less than a pass over all of them.
    numbers = np.sort(numbers)
    begin = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[begin], np.diff(begin, append=len(numbers))


def _sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all sets, where each set begins, and its size."""
    import numpy as np
    ranks = rows["ranks"].combine_chunks()
    size = ranks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return ranks.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size) - size, size


def _cell(asked: pa.Table, offered: pa.Table, k: int | None) -> pa.Table:
    """Pairs of a cell that reach the résumé's least score, of each résumé the best ``k``."""
    import numpy as np
    import pyarrow as pa

    asked = asked.sort_by("key")
    n, least_score = asked["n"].to_numpy().astype(np.int64), offered["least_score"].to_numpy().astype(np.int64)
    words, begin, size = _sets(asked)
    terms, start, many = _sets(offered)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    if len(words) and len(terms):
        # By term, and then by the highest score for which the term is in its set's prefix.
        of = np.repeat(np.arange(len(n)), size)
        left = size[of] - (np.arange(len(words)) - begin[of])
        code = words * 128 + 100 - np.minimum(100, 100 * (left * 4 // 3) // n[of])
        del left
        order = np.argsort(code, kind="stable")
        code, owner = code[order], of[order]
        del of, order
        wide, width = max(words.max(), terms.max()) + 1, len(n)
        first = np.searchsorted(code, np.arange(wide) * 128)
        for part in _pieces(many + 1):
            whole = slice(start[part.start], start[part.start] + many[part].sum())
            asks, who = terms[whole], np.repeat(np.arange(part.start, part.stop), many[part])
            low, reach = first[asks], asks * 128 + 100 - least_score[who]
            # Ascending numbers are found several times faster than others.
            order = np.argsort(reach)
            hits = np.empty_like(low)
            hits[order] = np.searchsorted(code, reach[order], "right")
            hits -= low
            del order, reach
            for some in _pieces(np.bincount(who - part.start, hits, part.stop - part.start).astype(np.int64) + 1):
                base, last = some.start + part.start, some.stop + part.start
                own = slice(start[base] - whole.start, start[last - 1] + many[last - 1] - whole.start)
                pair = owner[_runs(low[own], hits[own])] + np.repeat((who[own] - base) * width, hits[own])
                pair, common = _counted(pair, (last - base) * width)
                r, c = pair // width + base, pair % width
                least = -(-n[c] * least_score[r] // 100)
                near = (common > least // 4) & (least <= many[r])
                r, c = r[near], c[near]
                offers = asks[own] + (who[own] - base) * wide
                for few in _pieces(size[c]):
                    x, y = r[few], c[few]
                    wanted = words[_runs(begin[y], size[y])] + np.repeat((x - base) * wide, size[y])
                    held = offers[np.minimum(np.searchsorted(offers, wanted), len(offers) - 1)] == wanted
                    matched = np.bincount(np.repeat(np.arange(len(x)), size[y]), held, len(x)).astype(np.int64)
                    score = np.floor(matched / n[y] * 100)
                    enough = score >= least_score[x]
                    x, y, matched, score = x[enough], y[enough], matched[enough], score[enough]
                    if k is not None:
                        order = np.lexsort((y, -matched, -score, x))
                        x, y, matched = x[order], y[order], matched[order]
                        best = np.arange(len(x)) - np.searchsorted(x, x) < k
                        x, y, matched = x[best], y[best], matched[best]
                    found.append((y, x, matched))
    y, x, matched = map(np.concatenate, zip(*found))
    return pa.table({"asked_key": asked["key"].take(pa.array(y)), "offered_key": offered["key"].take(pa.array(x)),
                     "n_matched": pa.array(matched), "n_required": pa.array(n[y])})


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of (key, number, ranks) as parts of ``most`` terms or a little less, one row for each; a larger set is a part of its own."""
    import numpy as np
    import pyarrow as pa

    def part() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms, _, size = _sets(rows)
        one = [pa.array([rows[i].to_pylist()], pa.list_(rows.schema.field(i).type)) for i in (0, 1)]
        # Differences take less room on disk.
        numbers = (pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (size, np.diff(terms, prepend=0)))
        return pa.RecordBatch.from_arrays([*one, *numbers], ["key", "number", "size", "ranks"])

    held, terms = [], 0
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            done = int(ends[first - 1]) if first else 0
            last = int(np.searchsorted(ends, done + most - terms, "right"))
            if last <= first and not held:
                last = first + 1
            if last > first:
                held.append(batch.slice(first, last - first))
                terms += int(ends[last - 1]) - done
                first = last
            if first < len(sizes):
                yield part()
                held, terms = [], 0
    if held:
        yield part()


def _unpacked(row: pa.RecordBatch, side: str, number: str) -> pa.Table:
    import numpy as np
    import pyarrow as pa
    key, numbers, size, terms = (row.column(row.schema.get_field_index(f"{side}_{c}")) for c in ("key", "number", "size", "ranks"))
    begin = np.append(0, np.cumsum(np.frombuffer(size[0].as_py(), np.int32)))
    ranks = np.cumsum(np.frombuffer(terms[0].as_py(), np.int32), dtype=np.int32)
    ranks = pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), pa.array(ranks))
    return pa.table({"key": key.flatten(), number: numbers.flatten(), "ranks": ranks})


def _cells(rows: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield from _cell(_unpacked(row, "asked", "n"), _unpacked(row, "offered", "least_score"), k).combine_chunks().to_batches()


def _parts(sets: DataFrame, side: str, parts: int, most: int) -> str:
    """The folder of a table of parts, each in a file of its own."""
    kind = sets.schema["key"].dataType.simpleString()
    path = run_dir(sets.sparkSession, f"{side}-parts")
    packed = sets.coalesce(parts).mapInArrow(partial(_pack, most=most), f"key array<{kind}>, number array<int>, size binary, ranks binary")
    packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]).write.options(maxRecordsPerFile=1, compression="zstd").parquet(path)
    return path


def meetings(asked: DataFrame, offered: DataFrame, k: int | None = None) -> DataFrame:
    """``asked_key, offered_key, n_matched, n_required`` of pairs that reach the résumé's least score; with ``k``, all that can be among its best ``k``, smaller keys first.

    From (key, n, ranks) and (key, least_score, ranks), one row for a key, ranks ascending from the rarest; ``n`` may count terms that nobody offers and that have no rank.
    """
    spark = asked.sparkSession
    asked_terms, offered_terms = (x.agg(F.coalesce(F.sum(F.size("ranks")), F.lit(0))).first()[0] for x in (asked, offered))
    # Every part of the listings meets every part of the résumés: the larger side is cut into more parts.
    rows = max(-(-asked_terms // ASKED_TERMS), min(round((CELLS * asked_terms / max(1, offered_terms)) ** 0.5), asked_terms // LEAST_TERMS), 1)
    columns = max(-(-offered_terms // OFFERED_TERMS), min(-(-CELLS // rows), offered_terms // LEAST_TERMS), 1)
    left = asked.select("key", F.col("n").cast("int").alias("number"), F.col("ranks").cast("array<int>").alias("ranks"))
    right = offered.select("key", F.col("least_score").cast("int").alias("number"), F.col("ranks").cast("array<int>").alias("ranks"))
    # A fifth more than the mean, as partitions differ in size.
    sides = [_parts(x, side, parts, min(most, -(-terms * 6 // (5 * parts)) or 1)) for x, side, parts, most, terms in (
        (left, "asked", rows, ASKED_TERMS, asked_terms), (right, "offered", columns, OFFERED_TERMS, offered_terms))]
    # A session of its own, in which a task reads one file of each side and hands on one row at a time.
    apart = spark.newSession()
    for name, value in {"spark.sql.files.maxPartitionBytes": 1 << 30, "spark.sql.files.openCostInBytes": 1 << 30, "spark.sql.execution.arrow.maxRecordsPerBatch": 1}.items():
        apart.conf.set(name, value)
    one, other = (apart.read.parquet(path) for path in sides)
    kinds = [x.schema["key"].dataType.simpleString() for x in (asked, offered)]
    found = one.join(other.hint("shuffle_replicate_nl")).mapInArrow(
        partial(_cells, k=k), f"asked_key {kinds[0]}, offered_key {kinds[1]}, n_matched long, n_required long")
    path = run_dir(spark, "met")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def candidate_pairs(asked: DataFrame, offered: DataFrame, min_score: int) -> DataFrame:
    """Distinct (asked_key, offered_key) that reach the score, from (key, ranks) on both sides, ranks ascending from the rarest."""
    found = meetings(asked.select("key", F.size("ranks").alias("n"), "ranks"), offered.select("key", F.lit(min_score).alias("least_score"), "ranks"))
    return found.select("asked_key", "offered_key").distinct()


def _ranked(pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The best ``k`` listings of every class of résumés, from its best classes of listings."""
    order = Window.partitionBy("offered_key").orderBy(F.desc("score"), F.desc("n_matched"), "listing_id")
    scored = pairs.withColumn("score", share(F.col("n_matched"), F.col("n_required"))).join(members, "asked_key")
    return scored.drop("asked_key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_listings(
    listings: DataFrame, resumes: DataFrame, k: int = 10, min_score: int = 70, lexicon: Lexicon = SKILL_LEXICON,
) -> DataFrame:
    """``resume_id, rank, listing_id, score, n_matched, n_required``: up to ``k`` listings of each résumé that score ``min_score`` (1 to 100) or more.

    Best score first, then most terms in common, then the smallest listing_id. Listings come as (listing_id, text), résumés as (resume_id, text) with any number of rows for one id.
    Null and blank texts ask for nothing and offer nothing, and never appear; rows that repeat a listing_id are listings of their own. Nothing is left out for being frequent.
    """
    if not 1 <= min_score <= 100:
        raise ValueError("min_score must be between 1 and 100")
    # Rows are numbered once they are written, so that one of a class stands for it.
    listed = materialise(_classes(asked_terms(listings, lexicon), "terms").withColumn("row", F.monotonically_increasing_id()), "asked")
    first = Window.partitionBy("key").orderBy("listing_id", "row")
    members = listed.select("key", "listing_id", "row").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    # Numbers of classes ascend with their first listing.
    numbers = with_position(members.where("nth = 1").select("key", "listing_id", "row"), ["listing_id", "row"], "asked_key")
    members = members.select("key", "listing_id").join(numbers.select("key", "asked_key"), "key").drop("key")
    each = materialise(listed.select("row", "terms").join(numbers.select("row", "asked_key"), "row").select(
        "asked_key", F.size("terms").alias("n"), F.explode("terms").alias("term")), "asked-terms")
    offers = materialise(offered_terms(resumes, lexicon), "offers")
    # A term that nobody offers counts as asked, but has no rank.
    known = each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(offers.select("term").distinct(), "term", "left_semi")
    vocabulary = with_position(known, ["n", "term"], "rank").select("term", F.col("rank").cast("int").alias("rank"))
    asked = materialise(each.join(vocabulary, "term").groupBy("asked_key").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks")).where(F.size("ranks") * 100 >= F.col("n") * min_score).withColumnRenamed(
        "asked_key", "key"), "asked-ranks")
    people = offers.join(vocabulary, "term").groupBy("resume_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    people = materialise(_classes(people, "ranks"), "offered")
    offered = materialise(people.groupBy("key").agg(F.first("ranks").alias("ranks")).select(
        F.col("key").alias("set"), F.monotonically_increasing_id().alias("key"), "ranks"), "offered-ranks")
    few = asked.agg(F.percentile_approx("n", FIRST_SHARE)).first()[0] or 0
    begun = materialise(_ranked(meetings(asked.where(F.col("n") <= few), offered.withColumn("least_score", F.lit(min_score)), k), members, k), "begun")
    # A full list's last score is the least that another listing must have.
    full = begun.where(F.col("rank") == k).select(F.col("offered_key").alias("key"), F.col("score").alias("least_score"))
    wanted = offered.join(full, "key", "left").withColumn("least_score", F.coalesce("least_score", F.lit(min_score)))
    others = _ranked(meetings(asked.where(F.col("n") > few), wanted, k), members, k)
    order = Window.partitionBy("offered_key").orderBy(F.desc("score"), F.desc("n_matched"), "listing_id")
    best = begun.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = people.select("resume_id", F.col("key").alias("set")).join(offered.select("set", F.col("key").alias("offered_key")), "set")
    return best.join(ids, "offered_key").select("resume_id", "rank", "listing_id", "score", "n_matched", "n_required")
