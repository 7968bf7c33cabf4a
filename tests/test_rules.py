"""Golden cases: fates of lines, folders of CSV files, exact rates, IPv6, hot cells."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.helpers import sessions
from wireloom.operators import normalize, whitelist
from wireloom.operators.running import PIECE, cut_pieces, running_totals
from wireloom.operators.whitelist import in_range
from wireloom.operators.zero_byte import zero_byte_bursts
from wireloom.sources.events import read_events
from wireloom.sources.training import read_training

LINES = [
    '{"event_type": "flow", "flow_id": 1, "flow": {"state": "new"}}',
    '{"event_type": "flow", "flow_id": 2, "flow": "x"}',
    '{"event_type": "http", "flow_id": 3, "flow": "not its own"}',
    "",
    "   ",
    '[{"event_type": "flow"}]',
    '"text"',
    "{}",
    '{"event_type": "dns", "alert": null}',
    '{"event_type": "dns", "alert": {"severity": 1}}',
    '{"event_type": "dns"',
]


def test_the_fate_of_a_line_does_not_depend_on_the_columns_read(spark, tmp_path):
    (tmp_path / "log.json").write_text("\n".join(LINES) + "\n")
    raw = read_events(spark, str(tmp_path / "log.json"))
    assert tuple(normalize.line_counts(raw).first()) == (11, 6, 2, 1, 2)
    events = normalize.normalize_events(normalize.drop_flagged(raw))
    assert events.count() == len(events.collect()) == events.select("flow_id").count() == 2
    assert raw.select("flow_id").count() == len(LINES)


def test_csv_files_of_one_folder_may_differ_in_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration, Label\n12,BENIGN\nInfinity,ATTACK\n")
    (tmp_path / "b.csv").write_text("Label,Flow Duration\nATTACK,30\n,\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.csv").write_text(" Flow Duration, Label\n7,\"BENIGN, really\"\n")
    (tmp_path / "note.txt").write_text("x,y\n1,2\n")
    rows = read_training(spark, str(tmp_path))
    assert dict(rows.dtypes) == {" Flow Duration": "double", " Label": "string", "Label": "string", "Flow Duration": "double"}
    got = {(r[" Flow Duration"] or r["Flow Duration"], r[" Label"] or r["Label"]) for r in rows.collect()}
    assert got == {(12.0, "BENIGN"), (float("inf"), "ATTACK"), (30.0, "ATTACK"), (None, None), (7.0, "BENIGN, really")}
    with pytest.raises(ValueError):
        read_training(spark, str(tmp_path / "note.txt"))


def walk(times, least, rate):
    """Alerts of one key, flow by flow: ``(time, count)``."""
    count, out = 0, []
    for us in times:
        count += 1
        span = (us - times[0]) or 100_000
        if count >= least and Fraction(count * 1_000_000, span) > Fraction(str(rate)):
            out.append((us, count))
            count = 0
    return out


@pytest.mark.parametrize("rate", [1.0, 3.0, 0.7, 0.02])
def test_bursts_at_rates_that_divide_nothing(spark, rate):
    rng = random.Random(int(rate * 100))
    step = int(1_000_000 / rate)
    times = [0]
    for _ in range(300):
        times.append(times[-1] + rng.choice([step, step - 1, step + 1, step // 2]))
    rows = sessions(spark, [dict(us=t) for t in times])
    got = sorted((r.close_us, r.zero_byte_count) for r in zero_byte_bursts(rows, max_rate=rate, idle_seconds=1e6).collect())
    want = walk(times, 3, rate)
    assert [(us - got[0][0] + want[0][0], n) for us, n in got] == want


def test_a_rate_of_three_is_not_a_third_of_a_microsecond_off(spark):
    """Only the 3,000th flow, at 999.9995 s, makes more than three a second."""
    times = [0] + [999_999_500 - 2_998 + i for i in range(2_999)]
    rows = sessions(spark, [dict(us=t) for t in times])
    got = zero_byte_bursts(rows, min_count=2_500, max_rate=3.0, idle_seconds=1e6).collect()
    assert [r.zero_byte_count for r in got] == [3_000]


def test_ipv6_ranges(spark):
    ips = ["ff02::1", "ff02:0:0:0:0:0:1:2", "FF03::1", "fe80::1", "2001:db8::", "2001:db8:8000::1", "::", "1.2.3.4", "ff02::zz", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("ip", in_range(F.col("ip"), "ff02::/16"), in_range(F.col("ip"), "2001:db8::/33"), in_range(F.col("ip"), "::/0")).collect()}
    assert {i for i, t in got.items() if t[0]} == {"ff02::1", "ff02:0:0:0:0:0:1:2"}
    assert {i for i, t in got.items() if t[1]} == {"2001:db8::"}
    assert {i for i, t in got.items() if t[2]} == set(ips[:7])
    trusted = whitelist.TrustedServices(multicast=("ff02::/16", "224.0.0.0/24", "10.0.0.0/7"), known_services=(("fe80::1", 443),))
    rows = df.selectExpr("ip AS dst_ip", "443 AS dst_port", "'UDP' AS proto", "'s' AS src_ip").unionByName(
        spark.createDataFrame([("224.0.0.9", 1, "UDP", "s"), ("11.255.0.1", 1, "UDP", "s"), ("12.0.0.1", 1, "UDP", "s")], "dst_ip string, dst_port int, proto string, src_ip string")
    )
    by_table = whitelist.drop_whitelisted(rows, whitelist.whitelist_rules(spark, trusted)).collect()
    by_predicate = whitelist.apply_whitelist(rows, trusted).collect()
    assert sorted(map(str, by_table)) == sorted(map(str, by_predicate))
    assert len(by_table) == len(ips) - 3 + 1


def test_a_burst_inside_a_chunk_is_cut(spark):
    """All rows of a chunk within a hundredth of it: cuts by equal width would leave them whole."""
    rows = [("hot", 500_000 + i * 10) for i in range(1000)] + [("cold", i * 60_000) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, us bigint")
    pieces = cut_pieces(df, ["k"], "us", 1_000_000, target_rows=100).groupBy("k", PIECE).count()
    assert pieces.filter("k = 'hot'").agg(F.max("count")).first()[0] <= 300
    totals = running_totals(df.withColumn("one", F.lit(1)), ["k"], "us", {"n": "one"}, 1_000_000, target_rows=100)
    assert {(r.us, r.n) for r in totals.filter("k = 'hot'").collect()} == {(500_000 + i * 10, i + 1) for i in range(1000)}
