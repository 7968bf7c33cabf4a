import numpy as np

from tests.llm.brute import roots
from wireloom.llm import embeddings


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS n_links")


def vectors():
    rng = np.random.default_rng(9)
    base = embeddings.unit(rng.standard_normal((300, 16)))
    near = base[rng.integers(0, 40, 900)] + rng.standard_normal((900, 16)) * rng.choice([0.02, 0.06, 0.1], 900)[:, None]
    x = np.concatenate([base, near, base[:30] * 2.5, np.repeat(base[:1], 40, 0)])
    label = np.where(np.arange(len(x)) % 7 == 0, 1, 0)
    return [(i, [float(v) for v in row], int(label[i])) for i, row in enumerate(x)]


def test_counts_and_components_match_brute_force(spark):
    rows = vectors()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    find = roots(range(len(rows)), list(zip(*np.nonzero(np.triu(hit)))))
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table(spark, rows).repartition(4)).collect()}
    found = sum(n for n, _ in got.values())
    assert found <= hit.sum() and found >= 0.98 * hit.sum()
    exact = {i: (int(n), find[i]) for i, n in enumerate(hit.sum(1))}
    assert sum(got[i] == exact[i] for i in exact) >= 0.97 * len(exact)
    assert all(got[i][0] <= exact[i][0] and got[i][1] >= exact[i][1] for i in exact)


def test_visiting_every_cell_is_exact(spark, monkeypatch):
    fit = embeddings.fit
    monkeypatch.setattr(embeddings, "fit", lambda *a: (i := fit(*a))._replace(visits=len(i.first) * len(i.second)))
    monkeypatch.setattr(embeddings, "HOMES", 64)
    monkeypatch.setattr(embeddings, "VISITORS", 100)
    rows = vectors()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    find = roots(range(len(rows)), list(zip(*np.nonzero(np.triu(hit)))))
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: (int(n), find[i]) for i, n in enumerate(hit.sum(1))}


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, one, 0), (2, one, 0), (3, one, None), (4, None, 0), (5, [0.0] * 4, 0), (6, [1.0, None, 3.0, 4.0], 0), (7, [1.0, float("nan"), 3.0, 4.0], 0)]
    rows += [(8, [1.0, float("inf"), 3.0, 4.0], 0), (9, [], 0), (10, [1.0, 2.0, 3.0], 0), (11, [v * 1e300 for v in one], 0), (12, [v * 1e-300 for v in one], 0), (13, one, 1), (None, one, 0), (2, one, 0), (14, [2.0], 0), (15, [5.0], 0)]
    got = sorted(((r.id is None, r.id, r.n_links, r.component_id) for r in embeddings.near_duplicates(table(spark, rows)).collect()), key=str)
    want = [(False, i, 5, 1) for i in (1, 2, 2, 11, 12)] + [(True, None, 5, 1)] + [(False, i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13)] + [(False, 14, 1, 14), (False, 15, 1, 14)]
    assert got == sorted(want, key=str)


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(1)
    index = embeddings.Index(rng.standard_normal((5, 4)), rng.standard_normal((7, 4)), 9)
    x = rng.standard_normal((20, 8))
    sums = embeddings._distances(x[:, :4], index.first)[:, :, None] + embeddings._distances(x[:, 4:], index.second)[:, None, :]
    assert (index.traverse(x) == np.argsort(sums.reshape(20, 35), axis=1, kind="stable")[:, :9]).all()


def test_empty_table(spark):
    assert embeddings.near_duplicates(table(spark, [])).count() == 0
