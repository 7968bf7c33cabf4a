import random

import pytest

from wireloom.operators.running import activity_epochs, cut_pieces, presence_changes, running_rank, running_totals

CHUNK = 7


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(4)}", rng.randrange(0, 300), rng.randrange(-5, 9), i)
            for i in range(300)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k string, us bigint, v bigint, id int")


@pytest.mark.parametrize("target", [3, 10**6])
def test_running_totals(frame, data, target):
    got = {r.id: r.total for r in running_totals(frame, ["k"], "us", {"total": "v"}, CHUNK, target_rows=target).collect()}
    assert got == {i: sum(v for k2, u2, v, _ in data if k2 == k and u2 <= u) for k, u, _, i in data}


@pytest.mark.parametrize("target", [3, 10**6])
def test_running_rank(frame, data, target):
    got = {r.id: r["rank"] for r in running_rank(frame, ["k"], "us", ["id"], CHUNK, target).collect()}
    assert got == {i: sum(1 for k2, u2, _, j in data if k2 == k and (u2, j) <= (u, i)) for k, u, _, i in data}


def test_totals_restart_with_each_epoch(frame, data):
    epochs = activity_epochs(frame, ["k"], "us", 8, CHUNK)
    got = {r.id: (r.epoch_start, r.here) for r in running_totals(
        frame, ["k"], "us", {}, CHUNK, epochs, {"here": "v"}, target_rows=2).collect()}
    for k, u, _, i in data:
        start = u
        times = sorted({u2 for k2, u2, _, _ in data if k2 == k and u2 <= u}, reverse=True)
        for a, b in zip(times, times[1:]):
            if a - b > 8:
                break
            start = b
        assert got[i] == (start, sum(v for k2, u2, v, _ in data if k2 == k and start <= u2 <= u))


def test_presence_counts_distinct_values(spark, frame, data):
    hold = 20
    changes = [tuple(r) for r in presence_changes(frame, ["k"], "v", "us", hold, CHUNK).collect()]
    for k, u, _, _ in data:
        want = len({v for k2, u2, v, _ in data if k2 == k and u - hold < u2 <= u})
        assert sum(c for k2, u2, c in changes if k2 == k and u2 <= u) == want


def test_chunks_wider_than_the_gap_are_refused(frame):
    with pytest.raises(ValueError):
        activity_epochs(frame, ["k"], "us", 5, 6)
    with pytest.raises(ValueError):
        presence_changes(frame, ["k"], "v", "us", 5, 6)


@pytest.mark.parametrize("target", [3, 10**6])
def test_rows_are_cut_without_a_shuffle(spark, frame, target):
    """Hot keys, cells and cuts are few and sent to the rows; before, both joins sorted and shuffled all rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = cut_pieces(frame, ["k"], "us", CHUNK, target)
        assert "SortMergeJoin" not in cut._jdf.queryExecution().executedPlan().toString()
        rows = cut.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 300 and all(r._chunk <= r._piece <= r.us for r in rows)
    assert any(r._piece > r._chunk for r in rows) == (target == 3)
