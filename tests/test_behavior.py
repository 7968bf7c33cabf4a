import random

import numpy as np
import pytest

from tests.helpers import T0, session_rows, sessions
from wireloom.operators import behavior
from wireloom.operators.zero_byte import block_map, compose, zero_byte_bursts

S = 1_000_000
W = 300 * S


def timeline(spark, rows, **options):
    return {r.flow_id: r for r in behavior.behavior_scores(
        behavior.behavior_timeline(sessions(spark, rows), **options)).collect()}


def random_sessions(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        codes = rng.sample(["200", "401", "403", "407", "500"], rng.randrange(3))
        rows.append(dict(
            us=rng.randrange(0, 1500 * S, S // 2), src_ip="hot" if i % 3 == 0 else f"s{rng.randrange(3)}",
            dst_ip=f"d{rng.randrange(6)}", dst_port=rng.choice([0, 22, 80, 443]), app_proto=rng.choice(["", "http", "ssh"]),
            total_fwd_bytes=rng.randrange(1000), total_fwd_packets=rng.randrange(9), http_event_count=len(codes),
            http_status_codes=codes, state=rng.choice(["closed", "rst", "rejected"]), ssh_event_count=rng.randrange(2)))
    return session_rows(rows)


def failures(r):
    denied = sum(c in ("401", "403", "407") for c in r["http_status_codes"])
    return denied + (r["ssh_event_count"] > 0 and r["state"] == "rejected")


@pytest.mark.parametrize("target", [5, 10**6])
def test_window_matches_brute_force(spark, target):
    rows = random_sessions(2, 240)
    got = timeline(spark, rows, target_rows=target, chunk_seconds=40)
    for r in rows:
        mine = [q for q in rows if q["src_ip"] == r["src_ip"] and q["us"] <= r["us"]]
        seen = [q for q in mine if q["us"] > r["us"] - W]
        by_service = {}
        for q in seen:
            service = q["app_proto"] or f"TCP-{q['dst_port']}"
            by_service[service] = by_service.get(service, 0) + failures(q)
        g = got[r["flow_id"]]
        assert g.ips_in_window == len({q["dst_ip"] for q in seen})
        assert g.ports_in_window == len({q["dst_port"] for q in seen if q["dst_port"] > 0})
        assert g.bytes_in_window == sum(q["total_fwd_bytes"] for q in seen)
        assert g.packets_in_window == sum(q["total_fwd_packets"] for q in seen)
        assert g.max_auth_failures == max(by_service.values())
        start = r["us"]
        for t in sorted({q["us"] for q in mine}, reverse=True):
            if start - t > W:
                break
            start = t
        epoch = [q for q in mine if q["us"] >= start]
        assert g.epoch_start == T0 + start and g.total_flows == len(epoch)
        assert g.unique_dst_ips == len({q["dst_ip"] for q in epoch})
        assert g.total_auth_failures == sum(failures(q) for q in epoch)


def test_a_session_exactly_one_window_old_is_out(spark):
    got = timeline(spark, [dict(us=0, dst_ip="a"), dict(us=W, dst_ip="b"), dict(us=2 * W - 1, dst_ip="c")])
    assert [got[str(i)].ips_in_window for i in range(3)] == [1, 1, 2]
    assert [got[str(i)].total_flows for i in range(3)] == [1, 2, 3]  # a silence of exactly the window keeps the profile


def test_score_thresholds_are_strict(spark):
    def ports(n):
        return [dict(us=i, dst_port=i + 1) for i in range(n)]

    def hosts(n):
        return [dict(us=i, dst_ip=f"h{i}") for i in range(n)]

    assert timeline(spark, ports(10))["9"].port_scan_score == 0
    assert timeline(spark, ports(11))["10"].port_scan_score == 11 / 50
    assert timeline(spark, hosts(5))["4"].host_scan_score == 0
    assert timeline(spark, hosts(21))["20"].host_scan_score == 1
    denied = dict(http_event_count=1, http_status_codes=["401"], app_proto="http")
    got = timeline(spark, [dict(us=i, **denied) for i in range(4)])
    assert got["2"].brute_force_score == 0 and got["3"].brute_force_score == 4 / 20
    got = timeline(spark, [dict(us=0, total_fwd_bytes=300_000_000), dict(us=1, total_fwd_bytes=300)])
    assert got["0"].volume_anomaly_score == 0 and got["1"].volume_anomaly_score == pytest.approx(0.1000001)


def test_only_terminal_sessions_count_by_default(spark):
    rows = [dict(us=0), dict(us=1, close_reason="timeout"), dict(us=2, close_reason="flush")]
    assert set(timeline(spark, rows)) == {"0"}
    assert set(timeline(spark, rows, include_timeout=True)) == {"0", "1"}


def test_reports(spark):
    rows = [dict(us=i, dst_port=i + 1, src_ip="scan") for i in range(40)]
    rows += [dict(us=i, dst_ip=f"h{i}", src_ip="sweep") for i in range(16)] + [dict(us=0, src_ip="calm")]
    latest = behavior.latest_scores(behavior.behavior_scores(behavior.behavior_timeline(sessions(spark, rows))))
    assert [tuple(r) for r in behavior.scan_activity(latest).collect()] == [
        ("scan", 0.8, "port_scan"), ("sweep", 0.8, "host_scan")]
    assert [r.src_ip for r in behavior.top_anomalous_ips(latest, 2).collect()] == ["scan", "sweep"]
    assert tuple(behavior.analyzer_stats(latest).first()) == (3, 2)


# ---- bursts of empty flows


def alerts(spark, times, **options):
    df = zero_byte_bursts(sessions(spark, [dict(us=t) for t in times]), **options)
    return [(r.close_us - T0, r.zero_byte_count) for r in df.orderBy("close_us", "flow_id").collect()]


def walk(times, min_count=3, slice_us=S, idle=600 * S):
    out, count, first, last = [], 0, None, None
    for t in times:
        if last is None or t - last > idle:
            count, first = 0, t
        count, last = count + 1, t
        span = (t - first) or 100_000
        if count >= min_count and count * slice_us > span:
            out.append((t, count))
            count = 0
    return out


@pytest.mark.parametrize("times, want", [
    ([i * 100_000 for i in range(6)], [200_000, 500_000]),
    ([0, 0, 0], [0]),
    ([0, S, 3 * S], []),
    ([0, 1, 2, 9 * S, 9 * S + 1, 9 * S + 2], [2]),
])
def test_burst_golden_cases(spark, times, want):
    assert [t for t, _ in alerts(spark, times)] == want


@pytest.mark.parametrize("rate", [1.0, 0.02, 25.0])
def test_bursts_match_the_counter_walked_row_by_row(spark, rate):
    rng = random.Random(7)
    times, t = [], 0
    for _ in range(300):
        t += rng.choice([0, 1000, 30_000, 200_000, 900_000, 5 * S]) if rng.random() > 0.01 else 700 * S
        times.append(t)
    want = walk(times, slice_us=round(S / rate))
    assert want and alerts(spark, times, max_rate=rate) == want
    assert alerts(spark, times, max_rate=rate, target_rows=4, chunk_seconds=20) == want


@pytest.mark.parametrize("seed", range(4))
def test_maps_of_blocks_are_the_counter_of_every_entry(seed):
    rng = random.Random(seed)
    size, maps, slices = rng.choice([3, 40, 700]), [], []
    first = size
    for _ in range(5):
        need = size
        block = []
        for _ in range(rng.choice([1, 20, 200])):
            need += rng.choice([0, 1, 1, 30])
            block.append((need, rng.choice([1, 2, need - 1, need, rng.randrange(1, 5 * need)])))
        slices.append(block)
        maps.append(tuple(np.array(x) for x in block_map(block, size)))
        assert len(maps[-1][0]) <= len(block) + 1
        size = need

    def walked(count, blocks):
        for needed, flows in (s for b in blocks for s in b):
            for _ in range(flows):
                count = 0 if count + 1 >= needed else count + 1
        return count

    def looked_up(count, m):
        return count + m[1][np.searchsorted(m[0], count, "right") - 1]

    entries = rng.sample(range(first), min(first, 25))
    whole = maps[0]
    for m in maps[1:]:
        whole = compose(whole, m)
    pairs = compose(compose(maps[0], maps[1]), compose(compose(maps[2], maps[3]), maps[4]))
    for count in entries:
        assert looked_up(count, maps[0]) == walked(count, slices[:1])
        assert looked_up(count, whole) == looked_up(count, pairs) == walked(count, slices)


@pytest.mark.parametrize("rate, block", [(1.0, 30), (0.7, 7), (40.0, 4000)])
def test_bursts_do_not_depend_on_the_blocks(spark, rate, block):
    """Many blocks a key, empty ones among them, and several keys and activities."""
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(250):
        t += rng.choice([0, 1, 20_000, 300_000, 900_000, 4 * S]) if rng.random() > 0.01 else 700 * S
        times.append(t)
    rows = [dict(us=u, dst_ip=ip) for ip in ("a", "b") for u in (times if ip == "a" else times[40:])]

    def run(**options):
        found = zero_byte_bursts(sessions(spark, rows), max_rate=rate, **options)
        return sorted((r.dst_ip, r.close_us, r.flow_id, r.zero_byte_count) for r in found.collect())

    assert run(block_slices=block) == run(block_slices=10**9) != []


def test_bursts_need_empty_flows_and_a_full_key(spark):
    rows = [dict(us=i, total_bwd_bytes=1) for i in range(3)] + [dict(us=i, dst_port=0) for i in range(3)]
    rows += [dict(us=i, dst_ip="") for i in range(3)]
    assert zero_byte_bursts(sessions(spark, rows)).count() == 0
