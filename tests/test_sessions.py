import random

from pyspark.sql import functions as F

from tests.helpers import T0, events
from wireloom.operators.sessions import app_summary, number_sessions, session_metrics, sessionize

S = 1_000_000


def flow(us, state="new", **extra):
    return {"event_type": "flow", "us": us, "state": state, "start_us": T0 + us, "end_us": T0 + us,
            "fwd_pkts": 1, "bwd_pkts": 1, "fwd_bytes": 10, "bwd_bytes": 20, **extra}


def http(us, **extra):
    return {"event_type": "http", "us": us, **extra}


def reasons(df):
    return [tuple(r) for r in df.orderBy("flow_id", "session_no").select("session_no", "close_reason").collect()]


def test_gap_of_exactly_the_limit_stays_in_the_session(spark):
    df = sessionize(events(spark, [http(0), http(120 * S), http(240 * S + 1)]))
    assert [r.http_event_count for r in df.orderBy("session_no").collect()] == [2, 1]


def test_terminal_state_closes_and_later_events_open_a_new_session(spark):
    df = sessionize(events(spark, [flow(0), flow(S, "closed"), http(2 * S), flow(3 * S, "rst"), http(200 * S)]))
    assert reasons(df) == [(0, "terminal"), (1, "terminal"), (2, "flush")]


def test_terminal_then_silence_counts_once(spark):
    df = sessionize(events(spark, [flow(0, "fin"), http(500 * S), http(900 * S), flow(1000 * S, flow_id="z")]))
    assert reasons(df) == [(0, "terminal"), (1, "timeout"), (2, "flush"), (0, "flush")]


def test_identity_counters_and_lists(spark):
    rows = [
        http(0, http_method="GET", http_status="200", http_uri="/b", src_port=7),
        flow(S, start_us=T0 - S, fwd_bytes=1, app_proto="tls", src_port=9),
        http(2 * S, http_method="POST", http_uri="/a"),
        http(3 * S, http_method="GET", http_status="404", http_uri=""),
        {"event_type": "dns", "us": 4 * S, "dns_query": "q", "dns_answers": ["x", "y", "x", ""]},
        {"event_type": "fileinfo", "us": 5 * S},
        flow(6 * S, "closed", fwd_bytes=5, app_proto=None),
    ]
    r = session_metrics(sessionize(events(spark, rows))).first()
    assert (r.src_port, r.app_proto, r.state, r.total_fwd_bytes) == (7, "tls", "closed", 5)
    assert r.http_methods == ["GET", "POST"] and r.http_uris == ["/b", "/a"] and r.http_status_codes == ["200", "404"]
    assert r.dns_answers == ["x", "y"] and r.file_event_count == 1 and r.has_app_data
    assert r.duration == 7.0 and r.down_up_ratio == 4.0


def test_app_only_session_has_no_end(spark):
    r = session_metrics(sessionize(events(spark, [http(5), http(9)]))).first()
    assert r.end_ts is None and r.duration == 0 and r.app_proto == "http" and r.down_up_ratio == 0
    assert app_summary(sessionize(events(spark, [http(0, http_status="407")]))).first().has_http_auth


def test_start_is_the_first_app_event_or_an_earlier_flow_start(spark):
    late = sessionize(events(spark, [http(10), flow(20, start_us=T0 + 15)])).first()
    early = sessionize(events(spark, [flow(10, start_us=T0 + 5), http(20)])).first()
    assert late.start_ts.microsecond == 10 and early.start_ts.microsecond == 5


def test_events_of_equal_time_follow_seq(spark):
    rows = [http(0, seq=2), flow(0, "closed", seq=1)]
    assert reasons(sessionize(events(spark, rows))) == [(0, "terminal"), (1, "flush")]


def random_events(seed, n):
    """A third of the events share one flow id."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        us = rng.randrange(0, 900 * S, S // 2)
        fid = "hot" if i % 3 == 0 else f"f{rng.randrange(8)}"
        if rng.random() < 0.4:
            rows.append(flow(us, rng.choice(["new", "closed", "rst"]), flow_id=fid))
        else:
            rows.append(http(us, flow_id=fid, http_uri=f"/{rng.randrange(5)}"))
    return rows


def by_hand(rows, gap=120 * S):
    out, state = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1]["us"], x[0])):
        number, last, open_ = state.get(r["flow_id"], (0, None, False))
        if open_ and r["us"] - last > gap:
            number += 1
        out[i] = number
        ends = r["event_type"] == "flow" and r["state"] in ("closed", "rst")
        state[r["flow_id"]] = (number + 1, r["us"], False) if ends else (number, r["us"], True)
    return out


def test_hot_flow_is_cut_and_order_of_input_does_not_matter(spark):
    rows = random_events(1, 400)
    want = by_hand(rows)
    df = events(spark, rows)
    for frame, target in ((df, 10**6), (df.orderBy(F.rand(3)).repartition(7), 5), (df, 1)):
        got = {r.seq: r.session_no for r in number_sessions(frame, target_rows=target, chunk_seconds=50).collect()}
        assert got == want
    whole = sessionize(df).orderBy("flow_id", "session_no").collect()
    assert whole == sessionize(df, target_rows=4).orderBy("flow_id", "session_no").collect()


def test_cuts_spread_a_hot_key(spark):
    from wireloom.operators.running import cut_pieces

    rows = [(0, T0 + i * 1000) for i in range(9000)] + [(i, T0) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "k int, us bigint")
    sizes = cut_pieces(df, ["k"], "us", 60 * S, 500).groupBy("k", "_piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4000  # the chunk is cut evenly in time, not in rows
    assert sizes.filter("k = 0").count() > 1
