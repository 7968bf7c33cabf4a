"""Mixing sources to target weights by hash thresholds.

Every document has a fixed place on the hash line of its source. A source whose
target is ``k`` times its size plus a rest takes every document ``k`` times and
the documents below a threshold once more. The threshold is found on nested
histograms: words are summed by source and hash bucket, the bucket in which the
rest runs out is found by a running sum over the buckets, and only the
documents of that bucket are counted again, in finer buckets. Nothing is sorted
or sampled, and the final selection is a filter.

Null texts have no words and are never needed. A null source is a source of its
own, last in order. Rows that are equal in all of id, source and text share a place and are
taken together. An empty table gives an empty result. Output columns replace
input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wireloom.llm.text import quoted, word_count
from wireloom.sources.staging import materialize

#: Bits of the hash that one histogram resolves, and histograms at most.
BITS, LEVELS = 12, 5
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
#: Columns that a mix adds; input columns of these names are replaced.
MADE = ["size", "source_size", "weight", "target", "copies"]
CEILING = 2.0


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING
) -> DataFrame:
    """``source, source_size`` in; ``weight, target`` added.

    Sources in code point order, null last, get the weights in turn. ``budget``
    times the words of all sources is shared by weight; what exceeds
    ``ceiling`` times a source's size is shared again by the others. One narrow
    row per source; the driver sees two sums a round.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.get(table, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = materialize(ranked.withColumn("cap", F.col("source_size") * ceiling), "mix-sources")
    level = 0.0  # words per unit of weight; a source whose cap lies below is full
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(full, F.col("cap"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        raised = (budget * total - (row["used"] or 0.0)) / row["open"]
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    ceiling: float = CEILING,
) -> DataFrame:
    """One row per document: all its columns, ``size``, ``source_size``,
    ``weight``, ``target`` and ``copies``, how often the mix takes it."""
    own, names = _renamed(docs)
    mixed = _mix(own, names[key], names[source], names[text], weights, budget, ceiling)
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in MADE], *MADE)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that none of the columns made here has, and what they stand for."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), names


def _mix(docs: DataFrame, key: str, source: str, text: str, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    hashed = F.xxhash64(F.lit(7), F.col(key), F.col(source), F.col(text))
    sized = docs.withColumns({"size": word_count(F.col(text)), "place": F.shiftrightunsigned(hashed, 4)})
    narrow = materialize(sized.select(F.col(source).alias("source"), "size", "place"), "mix-sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, budget, ceiling)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("whole", whole.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    marks = _thresholds(narrow, plan)
    copies = F.col("whole") + F.when(F.col("place") < F.col("mark"), F.lit(1)).otherwise(F.lit(0))
    joined = sized.join(marks, F.col(source).eqNullSafe(F.col("source")), "left")
    return joined.withColumn("copies", copies).drop("place", "source", "whole", "mark")


def _thresholds(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` and ``mark``: documents placed below it fill the rest as nearly
    as whole documents can."""
    total_bits = BITS * LEVELS
    found = None
    rest = plan.select("source", F.col("rest").alias("want"))
    part = narrow.select("source", "size", "place")
    for depth in range(LEVELS):
        shift = total_bits - BITS * (depth + 1)
        last = depth == LEVELS - 1
        histogram = (
            part.withColumn("bucket", F.shiftrightunsigned("place", shift))
            .groupBy("source", "bucket")
            .agg(F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high"))
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = (
            histogram.withColumn("upto", F.sum("words").over(upto))
            .join(rest.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .select("source", "bucket", "words", "low", "high", "upto", "want")
        )
        # the bucket in which the running sum passes what is wanted
        edge = sums.filter((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("words") <= F.col("want")))
        edge = materialize(
            edge.groupBy("source").agg(F.min_by(F.struct("*"), "bucket").alias("e")).select("e.*"), "mix-edge"
        )
        left = F.col("want") - (F.col("upto") - F.col("words"))
        done = F.lit(True) if last else F.col("low") == F.col("high")
        # one place left: take it if that comes nearer to the target
        mark = F.when(left * 2 >= F.col("words"), F.col("high") + 1).otherwise(F.col("low"))
        settled = edge.filter(done).select("source", mark.alias("mark"))
        found = settled if found is None else found.unionByName(settled)
        if last:
            break
        rest = edge.filter(~done).select("source", left.alias("want"), "bucket")
        if rest.isEmpty():
            break
        at = rest.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"))
        part = part.join(
            at,
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftrightunsigned("place", shift) == F.col("_b")),
            "left_semi",
        )
        rest = rest.drop("bucket")
    renamed = found.withColumnRenamed("source", "_found")
    # a source whose rest is nothing, or all it has, has no edge
    nothing = F.coalesce(F.col("mark"), F.when(F.col("rest") > 0, F.lit(2**62)).otherwise(F.lit(0)))
    return (
        plan.join(renamed, F.col("source").eqNullSafe(F.col("_found")), "left")
        .withColumn("mark", nothing)
        .select("source", "source_size", "weight", "target", "whole", "mark")
    )


def take(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the
    columns of ``docs``."""
    own, names = _renamed(docs)
    mixed = _mix(own, names[key], names[source], names[text], **options)
    again = mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return again.select(*[F.col(n).alias(c) for c, n in names.items()])
