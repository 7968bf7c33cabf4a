"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct shingles of ``k`` words. One permutation
scatters the shingles over the 2**32 places, a second one, shifted circularly
by 0, 1, 2, ..., gives all coordinates of the signature. Bands of coordinates
propose pairs, and full shingle sets decide.

Texts with equal sets are one class from the start, and only classes are
compared. In each bucket every class is first compared with one that stands for
the bucket. Where the confirmed links leave a bucket in several components, its
classes are compared across components, but only those pairs whose rarest
shingles allow the similarity, an exact bound. So a group of near copies costs
about as many comparisons as it has members, and no link that could join two
components is left out.

Null and empty texts have an empty set and link with nothing. A text with fewer
than ``k`` words is one shingle, the whole sequence. Rows that share an id are
judged by their own texts. Rows with a null id take part and never name a
component, unless no row of the component has an id. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wireloom.functions.shipping import ship
from wireloom.llm.graph import components
from wireloom.llm.text import quoted, unused, words_of
from wireloom.sources.staging import materialize

#: A pair at the threshold of 0.8 shares no band with probability (1 - 0.8**4)**32, about 5e-8.
BANDS, ROWS = 32, 4
SHINGLE = 5
PERCENT = 80


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; A-Z lower-cased."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words).lower()
    if len(words) <= k:
        parts = [line]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        parts = [line[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts)))


def _permute(x: np.ndarray, odd: int, other: int) -> np.ndarray:
    """A bijection of the 32-bit numbers: xor-shifts and odd factors, each invertible."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(odd)
    x ^= x >> np.uint32(15)
    x *= np.uint32(other)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate ``i`` is the least value of the second permutation, shifted by
    ``i`` places, over the shingles' places under the first."""
    places = _permute((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(coordinates, np.iinfo(np.uint32).max, dtype=np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    for start in range(0, len(places), 1024):  # keeps the block in the cache
        block = places[None, start : start + 1024] - shifts
        np.minimum(out, _permute(block, 0x21F0AAAD, 0xD35A2D97).min(axis=1), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def band_keys(shingles: np.ndarray) -> np.ndarray:
    bands = signature(shingles).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, known = [], [], [], {}
            for text, h in zip(batch.column("text"), batch.column("row_hash").to_pylist()):
                got = known.get(h)
                if got is None or got[0] != text:
                    s = shingle_set(text.as_py(), k)
                    got = known[h] = (text, len(s), set_key(s) if len(s) else None, band_keys(s) if len(s) else None)
                sizes.append(got[1])
                keys.append(got[2])
                bands.append(got[3])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "row_hash", "n_shingles", "node", "bands"],
            )

    return run


def _confirmed(k: int, percent: int):
    """Pairs whose full sets are similar enough. A row names two classes and has
    a text of each; a text that isn't of its class (its 64-bit hash was shared)
    is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}

        def full(node: bytes, text: str) -> np.ndarray | None:
            s = recent.get(node)
            if s is None:
                s = shingle_set(text, k)
                if set_key(s) != node:
                    return None
                if len(recent) >= 64:
                    recent.clear()
                recent[node] = s
            return s

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                s, t = full(x, ta[i].as_py()), full(y, tb[i].as_py())
                if s is None or t is None:
                    continue
                common = len(s) + len(t) - len(np.union1d(s, t))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], ["a", "b"]
            )

    return run


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, text in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), batch.column("text")):
                s = shingle_set(text.as_py(), k)
                if set_key(s) == node:
                    n = len(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node] * n, pa.binary()), pa.array([root] * n, pa.binary()), pa.array([n] * n, pa.int64()), pa.array(s.view(np.int64))],
                        ["node", "root", "n", "shingle"],
                    )

    return run


def _across(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """All pairs of classes in different components that can be similar enough.

    Every class orders its shingles from the rarest on. At the first shingle that
    a pair has in common, what follows in either bounds the overlap, and two
    sets of ``n`` and ``m`` shingles need ``percent * (n + m) / (100 + percent)``.
    Of a group of edited copies, those whose edits alone exceed the difference
    allowed thus propose nothing, however large the group is.
    """
    rows = texts.join(open_, "node").mapInArrow(_shingle_rows(k), "node binary, root binary, n bigint, shingle bigint")
    rows = materialize(rows, "minhash-shingles")
    often = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "minhash-often")
    # a class's shared shingles, in order; those of its own come before them all
    ordered = rows.join(often, "shingle").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    placed = (
        ordered.filter(F.size("s") * 100 >= F.col("n") * percent)
        .select("node", "root", "n", (F.col("n") - F.size("s")).alias("own"), F.posexplode("s").alias("i", "s"))
        .select("node", "root", "n", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("own") - F.col("i")).alias("left"))
        .filter(F.col("left") * 100 >= F.col("n") * percent)
    )
    placed = materialize(placed, "minhash-prefixes")
    # the smaller of two sets needs more of it
    small = placed.filter(F.col("left") * (100 + percent) >= F.col("n") * 2 * percent)
    large = placed.select("shingle", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("m"), F.col("left").alias("left_b"))
    need = (F.col("n") + F.col("m")) * percent
    pairs = small.withColumnRenamed("node", "a").join(large, "shingle").filter(
        ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
        & (F.col("root") != F.col("root_b"))
        & (F.col("n") * 100 >= F.col("m") * percent)
        & (F.col("left") * (100 + percent) >= need)
        & (F.col("left_b") * (100 + percent) >= need)
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The confirmed ones of the candidate pairs ``a, b``."""
    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_confirmed(k, percent), "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: ``id``, ``row_hash`` (of the text), ``n_shingles``,
    ``node`` (the class of equal sets, null for an empty one), ``root`` (the
    component's class) and ``component_id``, the least id of the component."""
    body = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    hashed = body.withColumn("row_hash", F.xxhash64("text"))
    signed = materialize(
        hashed.mapInArrow(
            _signatures(k),
            f"id {body.schema['id'].dataType.simpleString()}, row_hash bigint, n_shingles bigint, node binary, bands array<bigint>",
        ),
        "minhash-signatures",
    )
    classes = signed.filter("node is not null").groupBy("node").agg(F.min("row_hash").alias("row_hash"), F.min("bands").alias("bands"))
    entries = materialize(classes.select("node", "row_hash", F.explode("bands").alias("bucket")), "minhash-buckets")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(entries.join(materialize(shared, "minhash-shared"), "bucket"), "minhash-members")
    # the class in the largest company stands for a bucket: of edited copies, the one the others were made from
    company = materialize(members.groupBy("node").agg(F.sum("size").alias("company")), "minhash-company")
    members = materialize(members.join(company, "node"), "minhash-members")
    hubs = members.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    members = materialize(members.join(materialize(hubs, "minhash-hubs"), "bucket"), "minhash-members")
    needed = members.select("node", "row_hash").distinct()
    texts = hashed.join(needed, "row_hash").select("node", "text")
    # equal texts of a class are needed once
    texts = materialize(texts.groupBy("node", F.xxhash64("text", F.lit(1)).alias("h")).agg(F.min("text").alias("text")).drop("h"), "minhash-texts")
    stars = members.filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = materialize(_links(stars, texts, k, percent), "minhash-links")
    found = materialize(components(links), "minhash-components")
    placed = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed, "minhash-placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    mixed = materialize(mixed, "minhash-mixed")
    open_ = materialize(placed.join(mixed, "bucket", "left_semi").select("node", "root").distinct(), "minhash-open")
    across = _across(open_, texts, k, percent)
    more = materialize(_links(across, texts, k, percent), "minhash-links")
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)), "minhash-components")
    table = signed.drop("bands").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = table.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return table.join(least, "root", "left").select(
        "id", "row_hash", "n_shingles", "node", "root", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` without those near another that stays: of each
    component the one with the least id, and of rows with that id and the same
    text one. Texts without words stay. The columns are those of ``docs``."""
    judged = near_duplicates(docs, key, text, k, percent)
    stay = judged.filter("root is not null and id <=> component_id").groupBy("root").agg(
        F.min(F.struct("row_hash", "id")).alias("s")
    )
    stay = materialize(stay.select("s.row_hash", "s.id"), "minhash-stay")
    h, i, rh, ri = (unused(docs, n) for n in ("_hash", "_id", "_stay_hash", "_stay_id"))
    marked = docs.withColumns({h: F.xxhash64(F.col(quoted(text))), i: F.col(quoted(key))})
    wordless = ~F.coalesce(F.col(quoted(text)), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    staying = stay.select(F.col("row_hash").alias(rh), F.col("id").alias(ri))
    kept = marked.join(staying, (F.col(h) == F.col(rh)) & F.col(i).eqNullSafe(F.col(ri)), "left_semi").filter(~wordless)
    return kept.dropDuplicates([h, i]).drop(h, i).unionByName(docs.filter(wordless))


ship(__name__)
