"""Ranked lexical search as an exact inner-product search with ball trees.

A document's vector has a whole number for each term, its saturated frequency; a
query's vector has the term's weight; the score is their inner product. The
documents are turned into sparse vectors once, over the terms that queries ask
for. Each task then builds ball trees over blocks of its vectors: a node has a
centre and a radius, so no vector in it can score more than ``query * centre +
length of the query * radius``, a bound that is computed in double precision and
raised by more than the error it can have. Nodes are visited best first; a
subtree whose bound is below the score of the query's last hit so far is left
out, and vectors at leaves are scored in whole numbers. The hits of all tasks
are merged by a ranked window, which keeps a task's best rows before the shuffle.

The number to beat carries over from block to block within a task. Before that,
a bounded sample of blocks gives every query a first one: the score of the last
hit among some of the documents can only be too low, so nothing is lost.

Null texts have no terms and are never found, nor are documents without a term
of the query. A null document id counts as a document and comes first among
equal scores. Repeated rows are documents of their own. Texts of any length are
read whole. An empty table, or no query, gives no hits. Other columns are ignored.

Queries are taken in batches of bounded size, because each task holds the
vectors of a batch's queries.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted
from wireloom.sources.staging import materialize

K = 50
#: Queries of one batch, vectors of one tree, and vectors of one leaf.
BATCH = 512
BLOCK = 2048
LEAF = 64
#: Numbers in the matrix of one block; with very many terms the block has fewer vectors.
CELLS = 8_000_000
#: Documents that give each query its first number to beat.
SAMPLE = 4096
#: Relative error of a bound, far above that of the sums it is made of.
SLACK = 1e-9
#: Bytes for the bytes of a text: letters, digits and all beyond ASCII stay, A-Z in lower case, the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


class Vectors(NamedTuple):
    table: DataFrame  # id, n, terms, tfs
    documents: int  # that have a term
    length: int  # terms of all of them
    df: dict[bytes, int]
    vocabulary: list[bytes]


def _vectors(vocabulary: list[bytes], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(vocabulary)}
        for batch in batches:
            ids, ns, terms, tfs, sizes = [], [], [], [], [0]
            for i, text in zip(batch.column(0), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                known = sorted((place[t], counts[t]) for t in counts.keys() & place.keys())
                ids.append(i.as_py())
                ns.append(len(found))
                terms += [k for k, _ in known]
                tfs += [c for _, c in known]
                sizes.append(len(terms))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(ns, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ],
                names=["id", "n", "terms", "tfs"],
            )

    return run


def vectors(docs: DataFrame, vocabulary: list[bytes], id: str = "doc_id", text: str = "text") -> Vectors:
    """Frequencies of ``vocabulary`` in every document, and what weights need from the corpus."""
    narrow = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = narrow.schema["id"].dataType
    schema = f"id {kind.simpleString()}, n bigint, terms array<int>, tfs array<bigint>"
    table = materialize(narrow.mapInArrow(_vectors(vocabulary, to_arrow_type(kind)), schema), "term-vectors")
    documents, length = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row for each term of the batch's queries
    held = table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    return Vectors(table, documents, length, {vocabulary[r.t]: r["count"] for r in held}, vocabulary)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Tree:
    """A ball tree over the rows of a matrix of whole numbers, kept in
    double precision, which holds them exactly."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows = exact = rows
        squares = np.einsum("ij,ij->i", exact, exact)
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        waiting = [(np.arange(len(rows)), -1)]
        while waiting:
            members, parent = waiting.pop()
            node = len(self.members)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            centre = exact[members].mean(axis=0)
            away = np.maximum(squares[members] - 2 * (exact[members] @ centre) + centre @ centre, 0)
            self.members.append(members)
            self.children.append(None)
            centres.append(centre)
            radii.append(math.sqrt(away.max() + SLACK * (squares[members].max() + centre @ centre)))
            if len(members) > leaf and away.max() > 0:
                # towards the vector farthest from the centre, or the one farthest from that
                a = exact[members[away.argmax()]]
                from_a = squares[members] - 2 * (exact[members] @ a) + a @ a
                b = exact[members[from_a.argmax()]]
                side = exact[members] @ (a - b) > (a @ a - b @ b) / 2
                if not side.any() or side.all():
                    side = np.arange(len(members)) % 2 == 0
                waiting += [(members[side], node), (members[~side], node)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no member of a node can exceed, by node and query (columns)."""
        inner = self.centres @ queries
        reach = self.radii[:, None] * np.sqrt((queries * queries).sum(axis=0))[None, :]
        return inner + reach + SLACK * (np.abs(inner) + reach) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the leaves that may hold a score of ``least`` or more;
        the caller may send a higher number for what follows."""
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            bound, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    reach = min(-bound, bounds[child])
                    if reach >= least:
                        heapq.heappush(heap, (-reach, child))
            else:
                members = self.members[node]
                scores = self.rows[members[:, None], terms[None, :]].astype(np.int64) @ weights
                least = max(least, (yield members, scores) or 0)


def _matrix(rows: list[tuple], width: int, documents: int, length: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, (_, n, terms, tfs) in enumerate(rows):
        m = 100 - 50 + (50 * n * documents) // length
        tf = np.array(tfs, dtype=np.int64)
        out[k, terms] = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    return out


def _searched(queries: list[tuple], width: int, documents: int, length: int, k: int, least: list[int], id_type: pa.DataType, block: int, leaf: int):
    """``queries``: ``(terms, weights)``; ``least``: the score below which no row of a query counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((width, len(queries)))
        for q, (terms, weights) in enumerate(queries):
            dense[terms, q] = weights
        # the best hits so far, as heaps with the worst one first
        best: list[list[tuple]] = [[] for _ in queries]
        lowest = [max(1, x) for x in least]
        ids: list = []

        def add(rows: list[tuple]) -> None:
            tree = Tree(_matrix(rows, width, documents, length), leaf)
            first = len(ids)
            ids.extend(r[0] for r in rows)
            bounds = tree.bounds(dense)
            for q, (terms, weights) in enumerate(queries):
                visit, told = tree.search(terms, weights, bounds[:, q], lowest[q]), None
                try:
                    while True:
                        members, scores = visit.send(told)
                        for at in np.flatnonzero(scores >= lowest[q]):
                            hit = (int(scores[at]), _Later(ids[first + int(members[at])]), first + int(members[at]))
                            if len(best[q]) < k:
                                heapq.heappush(best[q], hit)
                            else:
                                heapq.heappushpop(best[q], hit)
                        if len(best[q]) == k:
                            lowest[q] = max(lowest[q], best[q][0][0])
                        told = lowest[q]
                except StopIteration:
                    pass

        rows: list[tuple] = []
        most = max(1, min(block, CELLS // width))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2]:
                    rows.append(row)
                if len(rows) == most:
                    add(rows)
                    rows = []
        if rows:
            add(rows)
        found = [(q, ids[at], score) for q, hits in enumerate(best) for score, _, at in hits]
        if found:
            kinds = (pa.int32(), id_type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["query", "id", "score"])

    return run


class _Later:
    """Orders ids from last to first, null the first of all."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other: _Later) -> bool:
        if self.id is None or other.id is None:
            return other.id is None and self.id is not None
        return other.id < self.id

    def __eq__(self, other) -> bool:
        return self.id == other.id


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _batch(docs: DataFrame, items: list[tuple], id: str, text: str, k: int, block: int, leaf: int, sample: int, item_type: str) -> DataFrame:
    asked = [(i, sorted(set(terms_of(t)))) for i, t in items]
    vocabulary = sorted({t for _, terms in asked for t in terms})
    found = vectors(docs, vocabulary, id, text)
    place = {t: n for n, t in enumerate(vocabulary)}
    queries = [
        (
            np.array([place[t] for t in terms], dtype=np.int64),
            np.array([weight(found.documents, found.df.get(t, 0)) for t in terms], dtype=np.int64),
        )
        for _, terms in asked
    ]
    kind = docs.schema[id].dataType
    schema = f"query int, id {kind.simpleString()}, score bigint"

    def search(table: DataFrame, least: list[int]) -> DataFrame:
        run = _searched(queries, len(vocabulary), found.documents, found.length, k, least, to_arrow_type(kind), block, leaf)
        return table.mapInArrow(run, schema)

    spark = docs.sparkSession
    # the k-th score among some documents; at most k rows a query
    first = _ranked(search(found.table.limit(sample), [1] * len(queries)), k).filter(F.col("rank") == k).collect()
    least = {r["query"]: r.score for r in first}
    hits = _ranked(search(found.table, [least.get(q, 1) for q in range(len(queries))]), k)
    numbers = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], f"query int, item_id {item_type}")
    return hits.join(F.broadcast(numbers), "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    batch: int = BATCH,
    block: int = BLOCK,
    leaf: int = LEAF,
    sample: int = SAMPLE,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item. Items
    without a term find nothing."""
    asked = items.select(F.col(quoted(item)).alias("i"), F.col(quoted(item_text)).alias("t"))
    total = asked.count()
    parts = max(1, math.ceil(total / batch))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    item_type, id_type = (f.dataType.simpleString() for f in (asked.schema["i"], docs.schema[id]))
    out = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score bigint")
    for part in range(parts):
        rows = [(r.i, r.t) for r in dealt.filter(F.col("part") == part).collect() if terms_of(r.t)]
        if not rows:
            continue
        hits = _batch(docs, rows, id, text, k, block, leaf, sample, item_type)
        out = out.unionByName(hits)
    return out


ship(__name__)
