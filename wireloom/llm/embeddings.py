"""Near-duplicate embeddings with an inverted multi-index.

Vectors are halved and each half has a codebook of its own, fitted on a bounded
sample; a pair of code words is a cell of the product grid. A vector lives in
the cell nearest to it and visits the cells nearest to it in the order of the
multi-sequence traversal, so many that the target recall is reached: on pairs of
the sample that are near, and on sample vectors turned in a random direction by
exactly the angle of the threshold. What lives in a visited cell is verified
with the cosine in double precision. A pair is found if either vector visits the
other's cell, and counted once for each.

Equal vectors of one label are one class from the start. Cells are compared in
blocks of bounded size, homes against visitors, so a cell that holds a third of
all vectors is many tasks; a block returns counts and enough links to connect
what it found, never its pairs.

Vectors that are null, zero, or hold a null, an infinity or no number link with
nothing, as do rows without label and vectors of different lengths with each
other. Rows that share an id count as rows. A null id names a component only if
all its ids are null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wireloom.functions.shipping import ship
from wireloom.llm.graph import components
from wireloom.llm.text import quoted
from wireloom.sources.staging import materialize

THRESHOLD = 0.93
RECALL = 0.995
#: Vectors from which codebooks and the number of visits are fitted, at most about.
SAMPLE = 20_000
CELL_ROWS = 200
MAX_WORDS = 64
HOMES, VISITORS = 1024, 4096


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither large nor small values overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None, :]


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, words).argmin(axis=1)
        for i in range(len(words)):
            own = x[nearest == i]
            if len(own):
                words[i] = own.mean(axis=0)
    return words


class Index(NamedTuple):
    first: np.ndarray
    second: np.ndarray
    visits: int

    def traverse(self, x: np.ndarray, count: int | None = None) -> np.ndarray:
        """The ``count`` cells nearest to each row, nearest first.

        The cell of the ``a``-th and ``b``-th nearest words comes after all
        ``(a + 1) * (b + 1) - 1`` cells nearer in both halves, so only ranks with
        a product of at most ``count`` can be among the first ``count``."""
        count = self.visits if count is None else count
        half = x.shape[1] // 2
        one, two = _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)
        order1, order2 = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        ranks = [(a, b) for a in range(len(self.first)) for b in range(len(self.second)) if (a + 1) * (b + 1) <= count]
        a, b = np.array([r[0] for r in ranks]), np.array([r[1] for r in ranks])
        sums = np.take_along_axis(one, order1[:, a], 1) + np.take_along_axis(two, order2[:, b], 1)
        cells = order1[:, a] * len(self.second) + order2[:, b]
        nearest = np.argsort(sums, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(cells, nearest, 1)


def fit(sample: np.ndarray, labels: list, rows_per_label: float, threshold: float, recall: float) -> Index:
    """Codebooks for unit vectors, and visits for the wanted recall."""
    rng = np.random.default_rng(7)
    half = sample.shape[1] // 2
    k = int(min(MAX_WORDS, max(2, round((rows_per_label / CELL_ROWS) ** 0.5))))
    index = Index(codebook(sample[:, :half], k, rng), codebook(sample[:, half:], k, rng), 1)
    cells = len(index.first) * len(index.second)
    order = index.traverse(sample, cells)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    home = order[:, 0]
    # turned by the angle of the threshold: the hardest pairs that still count
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    turned = threshold * sample + (1 - threshold**2) ** 0.5 * unit(noise)
    seen = [np.take_along_axis(rank, index.traverse(turned, 1), 1)[:, 0]]
    known = np.array(labels, dtype=object)
    for label in sorted(set(labels), key=str):
        own = np.flatnonzero(known == label)
        for start in range(0, len(own), 512):
            part = own[start : start + 512]
            i, j = np.nonzero(sample[part] @ sample[own].T >= threshold)
            other = part[i] != own[j]
            if other.any():
                x, y = part[i[other]], own[j[other]]
                seen.append(np.minimum(rank[x, home[y]], rank[y, home[x]]))
    near = np.concatenate(seen[1:]) if len(seen) > 1 else seen[0]
    need = max(np.quantile(s, recall, method="higher") for s in (seen[0], near)) if len(sample) else 0
    return index._replace(visits=int(min(cells, need + 1)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its class: a hash of label and vector, null if it can't link."""
    for batch in batches:
        nodes, vectors, dims = [], [], []
        for label, value in zip(batch.column("label").to_pylist(), batch.column("vector")):
            flat = value.values if value.is_valid else None
            good = label is not None and flat is not None and len(flat) and flat.null_count == 0
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64) if good else None
            if not good or not np.isfinite(x).all() or not x.any():
                nodes.append(None)
                vectors.append(None)
                dims.append(None)
                continue
            data = (x + 0.0).tobytes()  # no negative zeros
            nodes.append(xxhash.xxh3_128_digest(label.encode() + b"\0" + data))
            small = x.astype(np.float32)
            vectors.append(small.tobytes() if (small.astype(np.float64) == x).all() else data)
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())],
            ["id", "label", "node", "dim", "vector"],
        )


def _floats(vectors: list[bytes], dim: int) -> np.ndarray:
    rows = [np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dim else np.float64) for v in vectors]
    return unit(np.array(rows, dtype=np.float64).reshape(len(rows), dim))


def _visits(indexes: dict[int, Index]):
    """Each class with the cells it visits; the first one is its home. Vectors of
    a length without index share one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dim").to_pylist(), batch.column("vector").to_pylist()
            cells: list = [[0]] * len(dims)
            for dim in set(dims) & set(indexes):
                at = [i for i, d in enumerate(dims) if d == dim]
                for i, row in zip(at, indexes[dim].traverse(_floats([vectors[i] for i in at], dim)).tolist()):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the two sides of a bipartite graph."""
    big = hit.shape[0]
    left = np.arange(hit.shape[0])
    while True:
        right = np.where(hit, left[:, None], big).min(axis=0, initial=big)
        new = np.minimum(left, np.where(hit, right[None, :], big).min(axis=1, initial=big))
        if (new == left).all():
            return left, right
        left = new


def _verified(threshold: float):
    def run(homes: pa.Table, visitors: pa.Table) -> pa.Table:
        none = {"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.binary())}
        if not homes.num_rows or not visitors.num_rows:
            return pa.table(none)
        dim = homes.column("dim")[0].as_py()
        h, q = homes.column("node").to_pylist(), visitors.column("q_node").to_pylist()
        hn, qn = homes.column("n").to_numpy(), visitors.column("q_n").to_numpy()
        hit = _floats(visitors.column("q_vector").to_pylist(), dim) @ _floats(homes.column("vector").to_pylist(), dim).T >= threshold
        place = {node: i for i, node in enumerate(h)}
        for i, node in enumerate(q):
            if node in place:
                hit[i, place[node]] = False
        if not hit.any():
            return pa.table(none)
        # a home that visits the visitor's own cell finds this pair itself
        cells = homes.column("cells").to_pylist()
        back = visitors.column("q_home").to_numpy()
        visited = np.zeros((len(h), max(max(map(max, cells)), int(back.max())) + 1), dtype=bool)
        for i, row in enumerate(cells):
            visited[i, row] = True
        alone = hit & ~visited[:, back].T
        q_links, h_links = hit @ hn, qn @ alone
        left, right = _spans(hit)
        node, links, other = [], [], []
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            node.append(q[i])
            links.append(int(q_links[i]))
            other.append(q[left[i]])
        for j in np.flatnonzero(hit.any(axis=0)).tolist():
            node.append(h[j])
            links.append(int(h_links[j]))
            other.append(q[right[j]])
        return pa.table({"node": pa.array(node, pa.binary()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.binary())})

    return run


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``id, n_links, component_id`` of every row."""
    own = vectors.select(
        F.col(quoted(key)).alias("id"), F.col(quoted(label)).cast("string").alias("label"), F.col(quoted(vector)).alias("vector")
    )
    kind = own.schema["id"].dataType.simpleString()
    rows = materialize(own.mapInArrow(_read, f"id {kind}, label string, node binary, dim int, vector binary"), "embedding-rows")
    classes = materialize(
        rows.filter("node is not null").groupBy("node").agg(
            F.min("label").alias("label"), F.min("dim").alias("dim"), F.min("vector").alias("vector"), F.count(F.lit(1)).alias("n")
        ),
        "embedding-classes",
    )
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels"))
    indexes = {}
    for size in sizes.orderBy(F.desc("n"), "dim").limit(8).collect():  # other lengths need no index to be compared
        if size["dim"] < 2:
            continue
        share = min(1.0, SAMPLE / size["n"])
        drawn = classes.filter((F.col("dim") == size["dim"]) & (F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < int(share * 1_000_003) + 1))
        picked = drawn.select("node", "label", "vector").limit(2 * SAMPLE).collect()
        picked.sort(key=lambda r: bytes(r["node"]))
        x = _floats([bytes(r["vector"]) for r in picked], size["dim"])
        indexes[size["dim"]] = fit(x, [r["label"] for r in picked], size["n"] / max(1, size["labels"]), threshold, recall)
    placed = materialize(
        classes.mapInArrow(_visits(indexes), "node binary, label string, dim int, vector binary, n bigint, cells array<int>"), "embedding-cells"
    )
    cell = ["label", "dim", "cell"]
    homes = placed.withColumn("cell", F.col("cells")[0])
    visitors = placed.select("node", "label", "dim", "vector", "n", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
    loads = homes.groupBy(*cell).agg(F.count(F.lit(1)).alias("homes")).join(
        visitors.groupBy(*cell).agg(F.count(F.lit(1)).alias("visitors")), cell
    )
    loads = materialize(
        loads.select(*cell, F.ceil(F.col("homes") / HOMES).alias("hb"), F.ceil(F.col("visitors") / VISITORS).alias("vb")), "embedding-loads"
    )
    spread = F.xxhash64("node", F.lit(3))
    dealt_homes = homes.join(loads, cell).withColumns({"h": F.pmod(spread, "hb"), "v": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("vb") - 1))})
    dealt_visitors = visitors.join(loads, cell).withColumns({"v": F.pmod(spread, "vb"), "h": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hb") - 1))})
    block = [*cell, "h", "v"]
    visiting = dealt_visitors.select(*[F.col(c).alias(f"q_{c}") for c in (*block, "node", "vector", "n", "home")])
    found = (
        dealt_homes.drop("hb", "vb")
        .groupBy(*block)
        .cogroup(visiting.groupBy(*[f"q_{c}" for c in block]))
        .applyInArrow(_verified(threshold), "node binary, links bigint, other binary")
    )
    found = materialize(found, "embedding-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "other"), "node", "other")
    of_class = classes.select("node", "n").join(linked, "node", "left").join(roots, "node", "left")
    of_class = materialize(
        of_class.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "embedding-roots",
    )
    table = rows.select("id", "node").join(of_class, "node", "left")
    least = table.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return table.join(least, "root", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


ship(__name__)
