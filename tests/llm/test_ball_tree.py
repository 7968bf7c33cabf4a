import math
import random
import re
from collections import Counter

import numpy as np

from wireloom.llm import ball_tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tfs:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t]
            )
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def made(n, seed):
    random.seed(seed)
    words = ["a", "B", "c1", "été", "ÉTÉ", "x_y", "zz", "日本"] + [f"w{i}" for i in range(60)]
    docs = [(i, random.choice(" \n-.").join(random.choices(words, k=random.randint(0, 40)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "..."), (None, docs[3][1]), (4, docs[4][1]), (4, docs[4][1]), (n + 3, "a w1 " * 20_000)]


def found(spark, docs, items, k, **options):
    frame = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id bigint, text string, query string, score int").repartition(3)
    hits = ball_tree.search(frame, spark.createDataFrame(items, "item_id bigint, text string"), k=k, **options)
    assert hits.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in hits.collect()), key=lambda r: r[:2])


ITEMS = [(1, "a B w1 w1 w2"), (2, "ÉTÉ 日本 zz"), (3, "nowhere"), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(60))), (7, "x_y")]


def test_hits_equal_those_of_all_scores(spark):
    docs = made(400, 5)
    assert found(spark, docs, ITEMS, 20, block=64, leaf=4, sample=50) == brute(docs, ITEMS, 20)


def test_batches_of_queries_and_copies(spark):
    docs = made(60, 6) + [(1000 + i, "a w1 w2") for i in range(150)]
    assert found(spark, docs, ITEMS, 10, batch=2, block=32, leaf=4, sample=8) == brute(docs, ITEMS, 10)


def test_no_documents_and_no_items(spark):
    assert found(spark, [(1, "a")], [], 5) == []
    assert found(spark, [], ITEMS, 5) == []
    assert found(spark, [(1, None), (2, "")], ITEMS, 5) == []


def test_bounds_hold_and_subtrees_are_left_out():
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1_000_000, (8, 30))
    rows = (centres[rng.integers(0, 8, 600)] + rng.integers(0, 2_000, (600, 30))).astype(np.float64)
    tree = ball_tree.Tree(rows, leaf=8)
    queries = rng.integers(0, 12_000, (30, 5)).astype(np.float64)
    bounds = tree.bounds(queries)
    for node, members in enumerate(tree.members):
        assert ((rows[members] @ queries).max(axis=0) <= bounds[node]).all()
    terms, weights = np.arange(30), queries[:, 0].astype(np.int64)
    scores = rows.astype(np.int64) @ weights
    least = int(np.sort(scores)[-5])
    seen = [m for m, _ in tree.search(terms, weights, bounds[:, 0], least)]
    assert {*np.flatnonzero(scores >= least)} <= {int(i) for m in seen for i in m}
    assert sum(map(len, seen)) < 300
