"""Running totals over time that survive hot keys.

A window partitioned by a key puts all rows of that key into one task. Here the
key's time line is cut into pieces: the window runs inside ``(key, piece)``, and
what precedes a piece arrives as a carry computed from one pre-aggregated row
per piece. Pieces are time chunks of a fixed width; a chunk of a key that holds
more than ``target_rows`` rows is cut further, by its own row counts, so a key
that holds a third of all rows is spread over as many tasks as its size asks
for. The only per-key sequence left is over pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"
PIECE = "_piece"
TARGET_ROWS = 1_000_000
#: Steps into which each ``target_rows`` of a large cell are divided before it is cut.
STEPS = 1024


def chunk_start(us: Column, width_us: int) -> Column:
    return us - F.pmod(us, F.lit(width_us).cast("bigint"))


def cut_pieces(df: DataFrame, keys: list[str], us: str, chunk_us: int, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``_chunk`` (start of the row's time chunk) and ``_piece`` (start of its
    piece). Both order like time within a key.

    Cells ``(key, chunk)`` of more than ``target_rows`` rows are counted again in
    narrow steps of time, more steps the more rows they have, and are cut between
    steps wherever another ``target_rows`` rows are full; a burst inside a chunk
    is thus cut as finely as its rows ask for. Equal times stay together.

    Only rows of keys with more than ``target_rows`` rows are counted by cell. There is at
    most one such key, cell or cut for every ``target_rows`` rows, so they are broadcast and
    the rows themselves aren't shuffled.
    """
    rows = df.withColumn(CHUNK, chunk_start(F.coalesce(us, F.lit(0)), chunk_us))
    cell = [*keys, CHUNK]
    count = F.count(F.lit(1)).alias("_n")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(chunk_us) / (F.ceil(F.col("_n") / target_rows) * STEPS)))
    many = F.col("_n") > target_rows
    hot = F.broadcast(rows.groupBy(*keys).agg(count).filter(many).select(*keys))
    large = F.broadcast(rows.join(hot, keys).groupBy(*cell).agg(count).filter(many).select(*cell, step.alias("_width")))
    inside = F.coalesce(us, F.lit(0)) - F.col(CHUNK)
    stepped = rows.join(large, cell).withColumn("_step", F.col(CHUNK) + inside - F.pmod(inside, F.col("_width")))
    counts = stepped.groupBy(*cell, "_step").agg(count)
    upto = Window.partitionBy(*cell).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("_full", F.floor(F.coalesce(F.sum("_n").over(upto), F.lit(0)) / target_rows))
    starts = numbered.groupBy(*cell, "_full").agg(F.min("_step").alias("_start"))
    cuts = F.broadcast(starts.groupBy(*cell).agg(F.collect_list("_start").alias("_starts")))
    begun = F.array_max(F.filter("_starts", lambda s: s <= F.coalesce(us, F.lit(0))))
    return rows.join(cuts, cell, "left").withColumn(PIECE, F.coalesce(begun, CHUNK)).drop("_starts")


def running_totals(
    df: DataFrame,
    keys: list[str],
    us: str,
    sums: dict[str, str],
    chunk_us: int,
    epochs: DataFrame | None = None,
    epoch_sums: dict[str, str] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add, for each ``out: source`` pair, the sum of ``source`` over all rows of
    the same key with a time not after this row's (equal times see each other).

    ``epoch_sums`` do the same but start again with each epoch of the key;
    ``epochs`` is the output of ``activity_epochs`` for the same chunk width.
    """
    epoch_sums = epoch_sums or {}
    both = {**sums, **epoch_sums}
    cell = [*keys, PIECE]
    rows = cut_pieces(df, keys, us, chunk_us, target_rows)
    inside = Window.partitionBy(*cell).orderBy(us).rangeBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*cell, CHUNK).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in both.items()])
    extra = []
    if epochs is not None:
        totals = totals.join(epochs, [*keys, CHUNK], "left")
        extra = ["epoch", "epoch_start"]

    def before(out: str) -> Column:
        part = [*keys, "epoch"] if out in epoch_sums else keys
        frame = Window.partitionBy(*part).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(f"_t_{out}").over(frame), F.lit(0)).alias(f"_c_{out}")

    carry = totals.select(*cell, *extra, *[before(o) for o in both])
    return (
        rows.withColumns({o: F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in both.items()})
        .join(carry, cell)
        .withColumns({o: F.col(o) + F.col(f"_c_{o}") for o in both})
        .drop(CHUNK, PIECE, *[f"_c_{o}" for o in both])
    )


def running_rank(
    df: DataFrame,
    keys: list[str],
    us: str,
    tie: list[str],
    chunk_us: int,
    target_rows: int = TARGET_ROWS,
    name: str = "rank",
) -> DataFrame:
    """Number the rows of each key 1, 2, ... by time and ``tie``."""
    cell = [*keys, PIECE]
    rows = cut_pieces(df, keys, us, chunk_us, target_rows)
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(us, *tie))
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        rows.withColumn("_inside", inside)
        .join(carry, cell)
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop(CHUNK, PIECE, "_inside", "_before")
    )


def activity_epochs(
    df: DataFrame, keys: list[str], us: str, gap_us: int, chunk_us: int
) -> DataFrame:
    """Number the stretches of activity of each key that are separated by more
    than ``gap_us`` of silence: one row per ``(key, chunk)`` with ``epoch`` and
    ``epoch_start``. Chunks must not be wider than the gap, so that such a
    silence only ever falls between chunks and the rows need no sort."""
    if chunk_us > gap_us:
        raise ValueError("chunks must not be wider than the gap")
    chunks = (
        df.withColumn(CHUNK, chunk_start(F.col(us), chunk_us))
        .groupBy(*keys, CHUNK)
        .agg(F.min(us).alias("_first"), F.max(us).alias("_last"))
    )
    order = Window.partitionBy(*keys).orderBy(CHUNK)
    silence = F.col("_first") - F.lag("_last").over(order)
    numbered = chunks.withColumn(
        "_opened", F.coalesce((silence > gap_us).cast("bigint"), F.lit(0))
    ).withColumn("epoch", F.sum("_opened").over(order))
    return numbered.select(
        *keys,
        CHUNK,
        "epoch",
        F.min("_first").over(Window.partitionBy(*keys, "epoch")).alias("epoch_start"),
    )


def presence_changes(
    df: DataFrame, keys: list[str], value: str, us: str, hold_us: int, chunk_us: int
) -> DataFrame:
    """``(keys, us, change)`` such that the running sum of ``change`` counts the
    distinct values seen in the last ``hold_us``.

    An occurrence keeps its value present for ``hold_us``. Inside one chunk only
    the first and last occurrence of a value matter, so the rows are aggregated
    map-side and no set of values is ever built.
    """
    if chunk_us > hold_us:
        raise ValueError("chunks must not be wider than the holding time")
    cells = (
        df.withColumn(CHUNK, chunk_start(F.col(us), chunk_us))
        .groupBy(*keys, value, CHUNK)
        .agg(F.min(us).alias("_first"), F.max(us).alias("_last"))
    )
    order = Window.partitionBy(*keys, value).orderBy(CHUNK)
    prior, following = F.lag("_last").over(order), F.lead("_first").over(order)
    appears = F.coalesce(F.col("_first") - prior >= hold_us, F.lit(True))
    leaves = F.coalesce(following - F.col("_last") >= hold_us, F.lit(True))
    bounds = cells.withColumns({"_appears": appears, "_leaves": leaves})
    edges = F.filter(
        F.array(
            F.when(F.col("_appears"), F.struct(F.col("_first").alias("us"), F.lit(1).alias("change"))),
            F.when(
                F.col("_leaves"),
                F.struct((F.col("_last") + hold_us).alias("us"), F.lit(-1).alias("change")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        bounds.select(*keys, F.explode(edges).alias("_edge"))
        .groupBy(*keys, F.col("_edge.us").alias(us))
        .agg(F.sum("_edge.change").alias("change"))
    )
