"""Exact percentiles of columns of any size in two passes over the rows.

The first pass makes one KLL sketch per column; its known error turns every
wanted rank into a bracket of values. The second pass counts the rows between
the brackets and keeps the values inside them, counted by value. What was kept
is dealt by ranges of values and ranked inside the ranges, so no percentile is
one task's work, however many rows its bracket holds. A bracket that turns out
not to hold its rank (the sketch's error is a bound of 99 %) is taken wider,
and at last over all values.

The driver sees counts and bounds only, a few for each column and probability.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wireloom.sources.staging import materialize

#: Size parameter of the sketches: about 100 KB a column, ranks within 0.13 %.
SKETCH_K = 4096
#: Half widths of the brackets that are tried, as shares of all rows.
SLACKS = (0.0015, 0.02, 1.0)

Bracket = tuple[float, float]


def _sketched(
    data: DataFrame, names: list[str], probabilities: list[float], slacks: tuple[float, ...]
) -> tuple[dict, dict]:
    """Rows of each column, and its brackets by slack and probability."""
    summary = data.agg(
        *[
            f.alias(f"{kind}_{n}")
            for n in names
            for kind, f in (
                ("n", F.count(n)), ("low", F.min(n)), ("high", F.max(n)),
                ("sketch", F.kll_sketch_agg_double(n, F.lit(SKETCH_K))),
            )
        ]
    )

    # every mark once, so that a sketch is opened once
    marks = sorted({m for p in probabilities for s in slacks for m in (p - 1.5 * s, p + 1.5 * s) if 0 < m < 1})
    if marks:
        values = {n: F.kll_sketch_get_quantile_double(f"sketch_{n}", F.array(*map(F.lit, marks))) for n in names}
    else:
        values = {n: F.lit(None).cast("array<double>") for n in names}
    row = summary.select(
        *[f"{kind}_{n}" for n in names for kind in ("n", "low", "high")],
        # a sketch takes no NaN, so it may be empty where the column is not
        *[F.when(F.kll_sketch_get_n_double(f"sketch_{n}") > 0, values[n]).alias(f"marks_{n}") for n in names],
    ).first()

    def bound(name: str, share: float, slack: float, end: str) -> float:
        # ranks are whole: of few rows a share this small holds none
        if 0 < share < 1 and row[f"n_{name}"] * slack >= 4 and row[f"marks_{name}"]:
            return row[f"marks_{name}"][marks.index(share)]
        return row[f"{end}_{name}"]

    brackets = {
        n: [[(bound(n, p - 1.5 * s, s, "low"), bound(n, p + 1.5 * s, s, "high")) for p in probabilities] for s in slacks]
        for n in names
    }
    return {n: row[f"n_{n}"] for n in names}, brackets


def _kept(data: DataFrame, brackets: dict[str, list[Bracket]]) -> DataFrame:
    """Per column the values inside a bracket and, without value, the rows between
    brackets by ``zone``, the number of brackets below them; ``part`` orders like the values."""

    def place(name: str) -> Column:
        value = F.col(name)
        inside = F.lit(False)
        zone = F.lit(0)
        for low, high in brackets[name]:
            inside = inside | value.between(low, high)
            zone = zone + (value > high).cast("int")
        return F.when(
            value.isNotNull(),
            F.struct(
                F.lit(name).alias("name"),
                F.when(~inside, zone).alias("zone"),
                F.when(inside, value).alias("value"),
            ),
        )

    rows = data.select(F.explode(F.array_compact(F.array(*[place(n) for n in brackets]))).alias("x"))
    counted = rows.groupBy("x.name", "x.zone", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return materialize(
        counted.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()), "percentiles"
    )


def _at_ranks(kept: DataFrame, wanted: dict[str, list[tuple[Bracket, int, int]]]) -> dict[tuple[str, int], tuple]:
    """``(value at the lower rank, value at the upper rank)`` for each column's n-th bracket, where it holds both."""
    parts = kept.groupBy("name", "part").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("size"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("name", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("name", "part").orderBy("value")
    ranked = (
        kept.filter("value is not null")
        .join(carry, ["name", "part"])
        .withColumn("upto", F.col("before") + F.sum("n").over(within))
        .select("name", "value", "n", "upto")
    )
    # rows between brackets lie below all values of the brackets that their zone has not passed
    between = kept.filter("zone is not null").groupBy("name", "zone").agg(F.sum("n").alias("n"))
    zones = {(r["name"], r["zone"]): r["n"] for r in between.collect()}
    below = {
        (name, i): sum(n for (c, zone), n in zones.items() if c == name and zone <= i)
        for name, targets in wanted.items()
        for i in range(len(targets))
    }
    asked = {
        name: sorted({rank - below[name, i] for i, (_, *ranks) in enumerate(targets) for rank in ranks})
        for name, targets in wanted.items()
    }
    pairs = [(F.lit(name), F.array(*[F.lit(r).cast("bigint") for r in ranks])) for name, ranks in asked.items()]
    ranks = F.element_at(F.create_map(*[x for pair in pairs for x in pair]), F.col("name"))
    hit = F.exists(ranks, lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto")))
    hits = ranked.filter(hit).collect()  # at most two for each column and probability

    def value_at(name: str, rank: int, bracket: Bracket) -> float | None:
        for h in hits:
            if h["name"] == name and h["upto"] - h["n"] <= rank < h["upto"]:
                low, high = bracket
                inside = low <= h["value"] and (h["value"] <= high or math.isnan(high))
                return h["value"] if inside or math.isnan(h["value"]) and math.isnan(high) else None
        return None

    return {
        (name, i): tuple(value_at(name, rank - below[name, i], bracket) for rank in target_ranks)
        for name, targets in wanted.items()
        for i, (bracket, *target_ranks) in enumerate(targets)
    }


def exact_percentiles(
    df: DataFrame, columns: list[str], probabilities: list[float], slacks: tuple[float, ...] = SLACKS
) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles (nulls ignored, NaN the largest value) for each column."""
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if not columns or not probabilities:
        return result
    names = {f"c{i}": c for i, c in enumerate(columns)}
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for n, c in names.items()])
    rows, brackets = _sketched(data, list(names), probabilities, slacks)
    rising = sorted(range(len(probabilities)), key=probabilities.__getitem__)
    open_targets = [(n, j) for n in names for j in rising if rows[n]]
    for attempt in range(len(slacks)):
        if not open_targets:
            break
        wanted: dict[str, list] = {}
        for n, j in open_targets:
            position = probabilities[j] * (rows[n] - 1)
            ranks = (math.floor(position), math.ceil(position))
            wanted.setdefault(n, []).append((tuple(brackets[n][attempt][j]), *ranks))
        kept = _kept(data, {n: [t[0] for t in targets] for n, targets in wanted.items()})
        found, missed, seen = _at_ranks(kept, wanted), [], dict.fromkeys(wanted, 0)
        for n, j in open_targets:
            low, high = found[n, seen[n]]
            seen[n] += 1
            if low is None or high is None:
                missed.append((n, j))
                continue
            position = probabilities[j] * (rows[n] - 1)
            result[names[n]][j] = low + (high - low) * (position - math.floor(position))
        open_targets = missed
    return result
