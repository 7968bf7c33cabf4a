"""Prefix trie of conversations by truncation peeling.

A conversation is a path: for each turn a digest of role and text, and the
text's length; the texts themselves are not moved. Paths are dealt into ranges
of their order, so that conversations with a common beginning lie side by side.
Each task peels its range: from the greatest depth down, the conversations that
end at a depth join the nodes that are left from below, the nodes are complete
and given out, the last turn is stripped from all of them, and they are grouped
again by what remains. Every node is found and summed up once.

A node whose members reach over the border of a range is given out by several
tasks. A child, a leaf and the length of a node's text are counted only by the
first (a leaf by the last) of them, which each task knows from two numbers, the
turns that its first and last path share with the neighbouring ranges. So all
values of a node add up, and one grouped sum puts such nodes together.

Turns are ordered by turn (null first), then role and a digest; null roles and
texts are empty. Rows without a conversation id belong to no conversation and
are left out. Repeated rows are turns of their own. Ids are whole numbers. A
path must fit into a task (24 bytes a turn), whatever the length of its texts;
a common beginning or a common whole may hold any number of conversations. An
empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted
from wireloom.sources.staging import materialize

#: Turns of one range, on average, and bytes of ids in one row on their way to a digest.
RANGE_TURNS = 200_000
CHUNK_BYTES = 1 << 16
ROOT = hashlib.md5(b"").digest()
#: Copies of a node's least id, so that the many children of one node ask several tasks for it.
SALTS = 16

_NODES = (
    "key binary, parent binary, depth bigint, conv_id bigint, parent_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, shared boolean, parent_shared boolean, range bigint, chunk bigint, ends binary"
)
_KINDS = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _NODES.split(", ")])


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, path``: the turns of each conversation, in order, as ``(digest, chars)``."""
    said, spoken = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role, text))
    # the length of the role parts it from the text
    digest = F.unhex(F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, spoken).cast("binary")))
    ordered = F.struct(
        F.col(quoted(turn)).alias("turn"), said.alias("role"), digest.alias("digest"), F.length(spoken).cast("bigint").alias("chars")
    )
    listed = conversations.filter(F.col(quoted(conv)).isNotNull()).select(F.col(quoted(conv)).cast("bigint").alias("conv"), ordered.alias("t"))
    # equal turns and roles are rare; their texts are told apart by the digest
    path = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return listed.groupBy("conv").agg(path.alias("path"))


def rebuilt(paths: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """Every conversation begins with the first ``h`` turns of the first one of its
    hundred, then come its own behind its first ``h``; ``h`` is a hash of the id."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    head = paths.filter(F.col("conv") % hundred == 0).select(F.col("conv").alias("base"), F.slice("path", 1, most - 1).alias("head"))
    own = paths.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % hundred)
    first = F.slice(F.coalesce("head", F.expr("slice(path, 1, 0)")), F.lit(1), F.col("h"))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return own.join(head, "base", "left").select("conv", F.concat(first, rest).alias("path"))


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _chain(digests: list[bytes], before: list[bytes], same: int) -> list[bytes]:
    """The keys of all beginnings of a path, the empty one first."""
    keys = before[: same + 1] or [ROOT]
    for d in digests[same:]:
        keys.append(hashlib.md5(keys[-1] + d).digest())
    return keys


class _Node:
    __slots__ = ("convs", "least", "children", "leaves", "saved", "row", "ends", "inner")

    def __init__(self, row: int, least: int):
        self.convs = self.children = self.leaves = self.saved = 0
        self.row, self.least, self.ends, self.inner = row, least, [], False


def _peel(rows: pa.Table, border: pa.Table) -> pa.Table:
    """The nodes of one range of paths, and the ids that end at those of them that
    other ranges have too, in pieces."""
    if not rows.num_rows:
        return _SCHEMA.empty_table()
    number, before, after = (border.column(c)[0].as_py() for c in ("range", "before", "after"))
    paths = sorted(zip(rows.column("digests").to_pylist(), rows.column("conv").to_pylist(), rows.column("chars").to_pylist()), key=lambda r: r[:2])
    keys: list[list[bytes]] = []
    ending: dict[int, list[int]] = {}
    for i, (path, _, _) in enumerate(paths):
        same = _common(paths[i - 1][0], path) if i else 0
        keys.append(_chain(path, keys[-1] if i else [], same))
        ending.setdefault(len(path), []).append(i)
    opening, closing = keys[0][: before + 1], keys[-1][: after + 1]

    def at(border: list[bytes], depth: int, key: bytes) -> bool:
        return 0 <= depth < len(border) and border[depth] == key

    out: list[tuple] = []
    owned: dict[bytes, int] = {}
    level: dict[bytes, _Node] = {}
    for depth in range(max(ending), -1, -1):
        for row in ending.pop(depth, ()):
            key, conv = keys[row][depth], paths[row][1]
            node = level.setdefault(key, _Node(row, conv))
            node.convs += 1
            node.least = min(node.least, conv)
            node.ends.append(conv)
        above: dict[bytes, _Node] = {}
        for key, node in level.items():
            early, late = at(opening, depth, key), at(closing, depth, key)
            shared = early or late
            parent = keys[node.row][depth - 1] if depth else None
            over = at(opening, depth - 1, parent) or at(closing, depth - 1, parent)
            if depth:
                node.saved += (node.convs if early else node.convs - 1) * paths[node.row][2][depth - 1]
            node.leaves += not node.inner and not late
            ids = ",".join(map(str, node.ends)).encode()
            sums = (node.convs, node.children, node.leaves, node.saved)
            out.append((key, parent, depth, node.least, None, *sums, None if shared else hashlib.sha256(ids).hexdigest(), shared, over, None, None, None))
            if shared:
                for n, c in enumerate(range(0, len(ids), CHUNK_BYTES)):
                    out.append((key, *[None] * 11, number, n, ids[c : c + CHUNK_BYTES]))
            owned[key] = node.least
            if depth:
                up = above.setdefault(parent, _Node(node.row, node.least))
                up.inner = True
                up.convs += node.convs
                up.least = min(up.least, node.least)
                up.children += not early
                up.leaves += node.leaves
                up.saved += node.saved
        level = above
    filled = [(*n[:4], owned[n[1]], *n[5:]) if n[1] is not None and not n[11] else n for n in out]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*filled), _SCHEMA)], schema=_SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key; rows come by key, range and chunk."""
    key = running = None
    for batch in batches:
        done = []
        for k, chunk, ends in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if k != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            elif chunk == 0:
                running.update(b",")
            running.update(ends)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "digest"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "digest"])


def _borders(ranges: DataFrame) -> DataFrame:
    """``range, before, after``: one row for each range."""
    place = F.struct("digests", "conv")
    ends = ranges.groupBy("range").agg(F.min(place)["digests"].alias("first"), F.max(place)["digests"].alias("last"))
    side = Window.orderBy("range")

    def shared(a: Column, b: Column) -> Column:
        differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(b.isNull(), -1).when(differs == 0, F.size(a)).otherwise(differs - 1).cast("bigint")

    before, after = F.lag("last").over(side), F.lead("first").over(side)
    return ends.select("range", shared(F.col("first"), before).alias("before"), shared(F.col("last"), after).alias("after"))


def trie(paths: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the trie of ``paths`` (``conv, path``): ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    flat = paths.select("conv", F.col("path.digest").alias("digests"), F.col("path.chars").alias("chars"))
    flat = materialize(flat, "trie-paths")
    turns = flat.agg(F.sum(F.size("digests") + 1)).first()[0] or 0
    n = max(1, math.ceil(turns / range_turns))
    dealt = flat.repartitionByRange(n, "digests", "conv").withColumn("range", F.spark_partition_id().cast("bigint"))
    ranges = materialize(dealt, "trie-ranges")
    nodes = materialize(ranges.groupBy("range").cogroup(_borders(ranges).groupBy("range")).applyInArrow(_peel, _NODES), "trie-nodes")
    chunks = nodes.filter("chunk is not null").select("key", "range", "chunk", "ends")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "range", "chunk").select("key", "chunk", "ends")
    digests = chunks.mapInArrow(_digest, "key binary, digest string")
    whole = nodes.filter("chunk is null and not shared").select("key", *_values(), "ends_sha256", "parent", "parent_id")
    parts = nodes.filter("chunk is null and shared").groupBy("key")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.min("parent").alias("parent"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    merged = merged.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", nothing))
    merged = materialize(merged.select("key", *_values(), "ends_sha256", "parent"), "trie-shared")
    asking = whole.filter("parent_id is null and depth > 0").drop("parent_id").unionByName(merged)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    least = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_id"), salt)
    asked = asking.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(least, ["parent", "salt"], "left")
    out = [F.col(c) for c in ("conv_id", "depth")] + [F.col("parent_id").alias("parent_conv_id")]
    out += [F.col(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    settled = whole.filter("parent_id is not null or depth = 0")
    return settled.select(*out).unionByName(asked.select(*out))


def _values() -> list[str]:
    return ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


ship(__name__)
