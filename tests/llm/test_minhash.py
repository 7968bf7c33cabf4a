import random

import numpy as np

from tests.llm.brute import near
from wireloom.llm import minhash
from wireloom.llm.graph import components


def corpus():
    random.seed(3)
    rows, n = [], 0

    def text(size):
        return [f"w{random.randrange(3000)}" for _ in range(size)]

    for _ in range(40):
        rows.append((n := n + 1, " ".join(text(random.randint(3, 120)))))
    for size in (60, 100):  # near copies at all distances
        base = text(size)
        for changes in range(30):
            copy = list(base)
            for _ in range(changes // 4):
                copy[random.randrange(size)] = f"v{random.randrange(9)}"
            rows.append((n := n + 1, " ".join(copy)))
    chain = text(200)  # each near its neighbours only
    for i in range(12):
        rows.append((n := n + 1, " ".join(chain[i * 5 : i * 5 + 100])))
    same = " ".join(text(50))
    rows += [(n := n + 1, same.upper() if i % 2 else same) for i in range(20)]
    rows += [(n := n + 1, t) for t in ("", None, "one two", "one  two", "ONE\ttwo", " \n ", "one two three")]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS id", "3 AS root").repartition(5)
    for k in (4, 5):
        got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k=k).collect()}
        assert got == near(rows, k, 80)


def test_one_of_each_group_stays(spark):
    rows = corpus() + [(1000, "a b c d e f g"), (1000, "a b c d e f g"), (None, "a b c d e f g"), (None, "x y z u v w"), (None, "x y z u v w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'k' AS lang")
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    stay = [r.doc_id for r in out.collect()]
    want = [i for i, (_, c) in near(corpus(), 5, 80).items() if i == c]
    assert sorted(i for i in stay if i is not None) == sorted(want + [1000])
    assert stay.count(None) == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        both = rng.integers(0, 2**63, size=300, dtype=np.uint64)
        a, b = np.unique(both[:240]), np.unique(both[60:])
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_permutation_is_one():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash._permute(x.copy(), 0x7FEB352D, 0x846CA68B))) == len(x)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}


def test_extra_columns_and_odd_names_when_dropping(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 1, 2), (1, text, "b", 1, 2), (2, text, "c", 1, 2), (3, "other words than those before it here", "d", 1, 2), (4, None, "e", 1, 2)]
    docs = spark.createDataFrame(rows, "`doc``id` bigint, text string, _rh string, _hash int, _id int")
    kept = minhash.drop_near_duplicates(docs, key="doc`id")
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 3, 4]
    long = spark.createDataFrame([(1, "w x y z " * 40_000), (2, "w x y z " * 40_000 + "end"), (3, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(long).collect()) == [1, 3]
