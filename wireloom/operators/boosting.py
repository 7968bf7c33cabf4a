"""Boosted trees of MLlib's method, one booster a task.

MLlib runs a job for each level of each tree, which for a grid of boosters over a
small table is nearly all of the time. Here a task gets the rows (packed in blocks)
and trains its booster alone: the same bins, gains, order of equal gains, leaves and
residuals as ``GBTClassifier`` without weights. Split candidates come from all rows,
where MLlib takes a sample of about 10,000. What a task holds is bounded by
``MAX_CELLS``; larger tables are for MLlib.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from wireloom.functions.shipping import ship
from wireloom.sources.staging import staging_path

MAX_CELLS = 1 << 22  # rows times features in one task, 32 MB
MAX_BINS = 32
BLOCK = "n int, features binary, labels binary, folds binary"
COUNTS = "job int, rounds int, label int, prediction int, n bigint"
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


class Job(NamedTuple):
    depth: int
    step: float
    rounds: tuple[int, ...]
    fold: int  # held out; -1 for none


class Level(NamedTuple):
    """Nodes of one depth: number, sum and sum of squares of their rows' targets; the split, ``left`` -1 for leaves."""

    first: int
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    gain: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray


def split_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values, at most ``bins - 1``, evenly by rows."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) <= bins - 1:
        return between
    # a threshold lies below value i where the rows up to i miss the target by more than those up to i - 1
    upto = np.cumsum(counts)
    both = (upto[:-1] + upto[1:]).astype(float)
    stride = target = len(values) / bins
    at, found = 0, []
    while (at := max(at, int(np.searchsorted(both, 2 * target, side="right")))) < len(both):
        found.append(between[at])
        target += stride
        at += 1
    return np.array(found)


def _impurity(n, s, q):
    return (q - s * s / n) / n


def _best_splits(bins, width, at, active, target, k, impurity):
    """For each of ``k`` nodes the first of the best splits: gain, feature, bin and
    the left and right sides' number, sum and sum of squares."""
    best = np.full(k, -np.finfo(float).max)
    feature, cut, sides = np.zeros(k, int), np.zeros(k, int), np.zeros((6, k))
    base, squares, total = at * width, target * target, None
    for f, column in enumerate(bins):
        index = base + (column if active is None else column[active])
        left = [
            np.bincount(index, weights, k * width).reshape(k, width).cumsum(axis=1, dtype=float)
            for weights in (None, target, squares)
        ]
        whole = [x[:, -1:] for x in left]
        if total is None:
            total = [x[:, 0].copy() for x in whole]
            impurity = _impurity(*total) if impurity is None else impurity
        left = [x[:, :-1] for x in left]
        right = [a - b for a, b in zip(whole, left)]
        gain = impurity[:, None] - left[0] / whole[0] * _impurity(*left) - right[0] / whole[0] * _impurity(*right)
        gain[(left[0] < 1) | (right[0] < 1)] = -np.finfo(float).max
        first = gain.argmax(axis=1)
        nodes = np.arange(k)
        better = np.flatnonzero(gain[nodes, first] > best)
        b = first[better]
        best[better], feature[better], cut[better] = gain[better, b], f, b
        sides[:, better] = [x[better, b] for x in (*left, *right)]
    return best, feature, cut, sides, total


def grow(bins: np.ndarray, width: int, target: np.ndarray, depth: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Level]]:
    """One regression tree: the values of its rows and of the ``others``, and its levels."""
    parts = [(bins, np.empty(bins.shape[1])), (others, np.empty(others.shape[1]))]
    at = [np.zeros(b.shape[1], np.intp) for b, _ in parts]
    rows: list = [None, None]  # those that are in no leaf yet; all, to begin with
    levels, first, where, size = [], 0, np.array([0]), 1
    everyone = impurity = None
    for level in range(depth):
        t = target if rows[0] is None else target[rows[0]]
        gain, feature, cut, sides, total = _best_splits(bins, width, at[0], rows[0], t, len(where), impurity)
        everyone = np.array(total) if everyone is None else everyone
        stats = everyone[:, where]
        inner = gain > 0
        children = sides[:, inner].reshape(2, 3, -1).transpose(1, 2, 0).reshape(3, -1)  # left, right, left, right, ...
        purity = _impurity(*children)
        ends = np.full(children.shape[1], level + 1 == depth) | (np.abs(purity) < np.finfo(float).eps)
        split = [np.full(size, -1.0), np.full(size, -1), np.zeros(size, int), np.full(size, -1)]
        for full, found in zip(split, (gain, feature, cut)):
            full[where[inner]] = found[inner]
        split[3][where[inner]] = first + size + 2 * np.arange(inner.sum())
        levels.append(Level(first, *everyone, *split))
        value, ended = stats[1] / stats[0], children[1] / children[0]
        rank, place = np.cumsum(inner) - 1, np.cumsum(~ends) - 1
        for p, (b, out) in enumerate(parts):
            here = np.arange(b.shape[1]) if rows[p] is None else rows[p]
            node, stay = at[p], inner[at[p]]
            if not stay.all():
                out[here[~stay]] = value[node[~stay]]
                here, node = here[stay], node[stay]
            child = 2 * rank[node] + (b[feature[node], here] > cut[node])
            over = ends[child]
            if over.any():
                out[here[over]] = ended[child[over]]
                here, child = here[~over], child[~over]
            rows[p], at[p] = here, place[child]
        first, size, everyone = first + size, children.shape[1], children
        where, impurity = np.flatnonzero(~ends), purity[~ends]
        if not len(where):
            break
    if size:
        levels.append(Level(first, *everyone, np.full(size, -1.0), np.full(size, -1), np.zeros(size, int), np.full(size, -1)))
    return *(out for _, out in parts), levels


def boost(features: np.ndarray, labels: np.ndarray, held: np.ndarray, job: Job):
    """Trains on the rows that are not ``held``; after each tree gives its number, its levels,
    the thresholds and the margins of the held rows. ``features`` has a row for each feature."""
    known, sign = features[:, ~held], np.where(labels[~held] > 0, 1.0, -1.0)
    if not len(sign):
        raise ValueError("no rows to train on")
    most = min(MAX_BINS, len(sign))
    points = [split_points(x, most) for x in known]
    width = max(len(x) for x in points) + 1
    bins, others = (np.array([np.searchsorted(p, x) for p, x in zip(points, part)], np.uint8) for part in (known, features[:, held]))
    target, margin, out = sign, np.zeros(len(sign)), np.zeros(others.shape[1])
    with np.errstate(all="ignore"):  # empty sides divide by 0 and are left out
        for n in range(max(job.rounds)):
            weight = job.step if n else 1.0
            mine, theirs, levels = grow(bins, width, target, job.depth, others)
            margin, out = margin + weight * mine, out + weight * theirs
            target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
            yield n, levels, points, out


def _packed(batches):
    """Rows as blocks of bytes, features one after the other."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        label, vector, fold = batch.columns
        values = vector.flatten().to_numpy(zero_copy_only=False)
        y = label.to_numpy(zero_copy_only=False)
        if vector.null_count or not np.isfinite(values).all():
            raise ValueError("features must be finite numbers")
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        x = np.ascontiguousarray(values.reshape(batch.num_rows, -1).T)
        folds = fold.to_numpy(zero_copy_only=False).astype(np.int32)
        cells = [[batch.num_rows], [x.tobytes()], [y.astype(np.uint8).tobytes()], [folds.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), *[pa.binary()] * 3))], BLOCK.replace(",", "").split()[::2])


def pack(df: DataFrame, label: str, vector: str, fold: str) -> DataFrame:
    return df.select(F.col(label).cast("double"), vector_to_array(vector), fold).mapInArrow(_packed, BLOCK)


def _rows(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds in an order that does not depend on the layout of the table."""
    x = np.concatenate([np.frombuffer(b["features"]).reshape(-1, b["n"]) for b in blocks], axis=1)
    y, folds = (np.concatenate([np.frombuffer(b[c], t) for b in blocks]) for c, t in (("labels", np.uint8), ("folds", np.int32)))
    order = np.lexsort((folds, y, *x))
    return x[:, order], y[order], folds[order]


def _by_job(blocks: DataFrame, jobs: list[Job]) -> DataFrame:
    """Every block for every job, a partition for each job."""
    every = blocks.select(F.explode(F.lit(list(range(len(jobs))))).alias("job"), "*")
    return every.repartitionById(len(jobs), F.col("job"))


def held_out_counts(blocks: DataFrame, jobs: list[Job]) -> DataFrame:
    """``COUNTS``: rows of each job's fold by label and prediction, for each number of rounds."""

    def run(batches):
        import pyarrow as pa

        found = [row for batch in batches for row in batch.to_pylist()]
        for number in sorted({b["job"] for b in found}):
            job = jobs[number]
            x, y, folds = _rows([b for b in found if b["job"] == number])
            held, out = folds == job.fold, []
            for n, _, _, margin in boost(x, y, held, job):
                if n + 1 in job.rounds:
                    pairs, sizes = np.unique(np.stack([y[held], margin > 0]), axis=1, return_counts=True)
                    out += [(number, n + 1, int(a), int(p), int(c)) for (a, p), c in zip(pairs.T, sizes)]
            names = COUNTS.replace(",", "").split()
            types = [pa.int64() if t == "bigint" else pa.int32() for t in names[1::2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names[::2])

    return _by_job(blocks, jobs).mapInArrow(run, COUNTS)


def _node_batch(tree: int, levels: list[Level], points: list[np.ndarray]):
    """A tree's nodes as MLlib saves them."""
    import pyarrow as pa

    n, s, q, gain, feature, cut, left = (np.concatenate(c) for c in list(zip(*levels))[1:])
    inner = left >= 0
    stats = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * 3, np.stack([n, s, q], axis=1).ravel())
    thresholds = [points[f][c] for f, c in zip(feature[inner], cut[inner])]
    ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
    whole = lambda a: pa.array(a.astype(np.int32))
    split = pa.StructArray.from_arrays(
        [whole(feature), pa.ListArray.from_arrays(ends, np.array(thresholds, float)), whole(np.full(len(n), -1))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    nodes = {
        "id": whole(np.arange(len(n))), "prediction": pa.array(s / n), "impurity": pa.array(_impurity(n, s, q)), "impurityStats": stats,
        "rawCount": pa.array(n.astype(np.int64)), "gain": pa.array(gain), "leftChild": whole(left),
        "rightChild": whole(np.where(inner, left + 1, -1)), "split": split,
    }
    return pa.RecordBatch.from_arrays(
        [whole(np.full(len(n), tree)), pa.StructArray.from_arrays(list(nodes.values()), list(nodes))], ["treeID", "nodeData"]
    )


def fit(blocks: DataFrame, booster: GBTClassifier, features: int) -> GBTClassificationModel:
    """``booster`` fitted on all rows, as MLlib's model: its nodes are written in the form MLlib saves them."""
    spark, rounds = blocks.sparkSession, booster.getMaxIter()
    job = Job(booster.getMaxDepth(), booster.getStepSize(), (rounds,), -1)

    def run(batches):
        found = [row for batch in batches for row in batch.to_pylist()]
        if found:
            x, y, _ = _rows(found)
            for tree, levels, points, _ in boost(x, y, np.zeros(len(y), bool), job):
                yield _node_batch(tree, levels, points)

    # a booster of one round gives parameters and metadata
    row = F.array(*[F.col("id").cast("double")] * features)
    seed = spark.range(2).select(F.col("id").cast("double").alias(booster.getLabelCol()), array_to_vector(row).alias(booster.getFeaturesCol()))
    small, path = staging_path(spark, "model"), staging_path(spark, "model")
    booster.copy({booster.maxIter: 1}).fit(seed).write().save(small)
    about = json.loads(spark.read.text(f"{small}/metadata").first()[0])
    about["paramMap"]["maxIter"] = about["numTrees"] = rounds
    tree = json.loads(spark.read.parquet(f"{small}/treesMetadata").first()[1])
    trees = [(n, json.dumps({**tree, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), job.step if n else 1.0) for n in range(rounds)]
    _by_job(blocks, [job]).mapInArrow(run, NODES).write.parquet(f"{path}/data")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)


ship(__name__)
