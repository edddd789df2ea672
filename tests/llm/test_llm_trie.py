"""The conversation trie against a plain version: short, long, turnless and repeated conversations."""

import random

import pytest

import brute
from rolefold.llm import prefix_trie
from rolefold.llm.prefix_trie import block_rows, node_ends, numbered_turns, rebuilt_trie, rebuilt_turns, trie_nodes

SCHEMA = "conv_id long, turn long, role string, text string, node string, prior string, block long, t1 string, n_turns long, place long, pos long, d int"
CLASH = ("n", "p", 3, "t", 5, 6, 7, 8)


@pytest.fixture
def built(spark):
    def run(rows):
        frame = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
        return sorted(tuple(-1 if x is None else x for x in r) for r in rebuilt_trie(frame).collect())
    return run


def talk(seed, n):
    random.seed(seed)
    return [("user" if k % 2 == 0 else "assistant", random.choice(["yes", "no", "é ü", "tell me more " * 3])) for k in range(n)]


def corpus():
    rows = []
    for c in range(60):
        rows += [(c, k, *t) for k, t in enumerate(talk(c % 7, 1 + c * 5 % 13))]
    rows += [(100 + c, k, *t) for c in range(6) for k, t in enumerate(talk(1, 75 + c // 2))]       # long ones that share most of their blocks
    rows += [(201, 0, "user", "all of its own turns are replaced"), (203, 0, None, None), (204, None, "user", "no number"), (204, 3, "user", None)]
    rows += [(205, 1, "user", "tie b"), (205, 1, "user", "tie a"), (205, 1, "user", "tie a")]
    rows += [(None, 0, "user", "belongs nowhere"), (300, 0, "user", "word " * 100_000)]
    return rows


def test_trie_of_rebuilt_conversations(built):
    rows = corpus()
    assert built(rows) == brute.trie(rows)


def test_many_levels_of_blocks_and_of_running_sums(built, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "TAIL", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rows = corpus()
    assert built(rows) == brute.trie(rows)


def test_one_conversation_for_all(built):
    rows = [(c, k, *t) for c in range(40) for k, t in enumerate(talk(3, 9))]
    assert built(rows) == brute.trie(rows)


def test_empty_and_turnless(built):
    assert built([]) == []
    only = next(c for c in range(1, 99) if c % 5 and __import__("zlib").crc32(str(c).encode()) % 9 > 0)
    rows = [(only, 0, "user", "gone")]
    assert built(rows) == brute.trie(rows) == [(only, 0, -1, 1, 0, 1, 0, brute.digest(str(only)))]


def test_no_task_gets_a_whole_hot_node(spark):
    """Prefixes are counted before they are shuffled, and blocks of one long conversation are spread."""
    frame = spark.createDataFrame(corpus(), "conv_id long, turn long, role string, text string")
    turns, lengths = rebuilt_turns(numbered_turns(frame))
    blocks = block_rows(turns, lengths)
    assert blocks.groupBy("conv_id", "block").count().where("count > 1").isEmpty()
    assert node_ends(blocks).count() == lengths.count()
    rolled = prefix_trie._rolled(blocks, "max(n_turns) AS longest")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in rolled and rolled.count("HashAggregate") >= 2 and "SortAggregate" not in rolled
    nodes = trie_nodes(blocks)
    assert nodes.select("node").distinct().count() == nodes.count()
