"""Connected components of a graph whose edges are rows.

Alternating large-star and small-star steps: every node's larger neighbours are
linked to the least node of its neighbourhood, then its smaller ones. Each step
is an aggregation of one minimum per node and a join that Spark may split where
a node has very many edges; after a few rounds every component is a star around
its least node. Nothing of the graph reaches the driver but a row count and a
checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wireloom.sources.staging import materialize


def _stars(edges: DataFrame, name: str) -> DataFrame:
    return materialize(edges.filter("u <> v").distinct(), name)


def _sum(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another one; ``root`` is
    the least node that can be reached. Loops and repeated edges don't matter,
    edges with a null end are left out. No edges, no rows."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    current = _stars(pairs, "cc-edges")
    state = _sum(current)
    while state[0]:
        # minima are written, so that the join below deals both sides out anew and may split a hot node
        both = current.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            current.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "cc-least")
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = _stars(large, "cc-large")
        parent = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-parent")
        small = large.join(parent, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        following = _stars(small.select("e.*"), "cc-edges")
        if (now := _sum(following)) == state:
            break
        current, state = following, now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
