import pytest

from pyspark.sql import functions as F

from wireloom.llm import mixing


def documents(spark):
    rows = [(i, "w " * (i % 40 + 1), s) for s, n in (("b", 3000), ("a", 200), ("c", 10), (None, 300)) for i in range(n)]
    rows = [(j, t, s) for j, (_, t, s) in enumerate(rows)] + [(None, None, "a"), (10_000, "", "c"), (10_001, "x", "empty"), (10_002, None, "none")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def targets(sizes, weights=(3, 1, 2), budget=1.5, ceiling=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if ceiling * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = ceiling * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_taken_words_come_near_their_targets(spark):
    rows = mixing.mix(documents(spark)).collect()
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and r.copies in (0, 1, 2)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40, s


def test_reruns_agree_whatever_the_partitions(spark):
    one = {(r.doc_id, r.source): r.copies for r in mixing.mix(documents(spark)).collect()}
    two = {(r.doc_id, r.source): r.copies for r in mixing.mix(documents(spark).repartition(7)).collect()}
    assert one == two


def test_take_repeats_rows_and_keeps_columns(spark):
    df = documents(spark).selectExpr("*", "1 AS size", "'x' AS copies")
    out = mixing.take(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mixing.mix(documents(spark)).collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_extra_columns_with_the_names_in_use_inside(spark):
    rows = [(i, "w " * (i % 7), "ab"[i % 2], 1, 2, 3, 4, 5, 6, 7) for i in range(200)]
    odd = "doc_id bigint, text string, source string, whole int, mark int, _t int, _ss int, _w int, place int, _source int"
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, source string")
    mixed = mixing.mix(spark.createDataFrame(rows, odd))
    assert {(r.doc_id, r.copies) for r in mixed.collect()} == {(r.doc_id, r.copies) for r in mixing.mix(plain).collect()}
    assert mixed.columns[:10] == "doc_id text source whole mark _t _ss _w place _source".split() and mixed.first().whole == 1
    long = plain.withColumn("text", F.when(F.col("doc_id") == 7, F.repeat(F.lit("w "), 300_000)).otherwise(F.col("text")))
    assert mixing.mix(long).filter("doc_id = 7").first()["size"] == 300_000
