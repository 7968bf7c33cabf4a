import hashlib
import random
import zlib

from wireloom.llm import prefix_trie
from tests.llm.brute import trie as brute_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def found(spark, rows, extra=False, **options):
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    if extra:
        for name in ("key", "path", "range", "chunk", "`odd`"):
            docs = docs.withColumn(name, docs.turn)
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(docs)), **options)
    assert nodes.columns == COLUMNS
    return sorted(tuple(r) for r in nodes.collect())


def made(n, turns, seed):
    random.seed(seed)
    rows = []
    for conv in range(n):
        last = random.choice([1, 2, turns, turns])
        for turn in range(last):
            rows.append((conv, turn, random.choice("ua"), random.choice(["", "x", "yé", "zz\U0001f600"])))
    return rows


def test_nodes_equal_those_of_all_beginnings(spark):
    rows = made(230, 4, 1)
    want = brute_trie(rows)
    assert found(spark, rows) == want
    # many small ranges: most nodes reach over their borders
    assert found(spark, rows, extra=True, range_turns=40) == want


def test_a_third_of_all_conversations_are_the_same(spark):
    rows = made(200, 3, 2) + [(1000 + 100 * c + 7, t, "u", "same") for c in range(120) for t in range(4)]
    want = brute_trie(rows)
    assert found(spark, rows, range_turns=60) == want
    assert max(r[3] for r in want if r[1] == 3) >= 20


def test_long_conversations(spark):
    rows = [(c, t, "u", str(t if c % 2 or t < 120 else -t)) for c in range(4) for t in range(200)]
    assert found(spark, rows, range_turns=500) == brute_trie(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (0, 2, "u", "b"), (0, None, "", ""), (None, 1, "u", "c"), (205, 1, "u", "d")]
    rows += [(3, 0, "b", "late"), (3, 0, "a", "early")]
    assert found(spark, rows) == brute_trie(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_only_turnless_conversations(spark):
    conv = next(c for c in range(100, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6)
    assert found(spark, [(conv, 0, "u", "a")]) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]
