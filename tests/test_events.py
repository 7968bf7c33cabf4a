import json

from pyspark.sql import functions as F

from tests.helpers import events
from wireloom.operators import normalize, whitelist
from wireloom.operators.whitelist import TrustedServices, in_range
from wireloom.sources.events import read_events


def lines(tmp_path, *rows):
    path = tmp_path / "log.json"
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


BASE = dict(flow_id=7, src_ip="10.0.0.1", src_port=5, dest_ip="10.0.0.9", dest_port=80, proto="TCP",
            timestamp="2024-01-01T00:00:01.5+0000")


def test_edge_lines(spark, tmp_path):
    path = lines(
        tmp_path,
        {**BASE, "event_type": "flow", "flow": {"state": "new", "pkts_toserver": "3", "bytes_toclient": 4}},
        '{"event_type": "flow", ',
        {},
        {**BASE, "event_type": "stats"},
        {**BASE, "event_type": "http", "alert": {"severity": 1}},
        {**BASE, "event_type": "http", "http": {"status": 404, "url": ""}, "timestamp": "2024-01-01T00:00:01Z"},
        {**BASE, "event_type": "http", "http": {"status": "200"}, "timestamp": "2024-01-01T01:00:01+01:00"},
        {**BASE, "event_type": "dns", "dns": None, "src_ip": "fe80::1", "dest_port": None, "timestamp": "soon"},
        {**BASE, "event_type": "dns", "dns": {"rrname": "a.b", "grouped": {"A": ["1.2.3.4"], "CNAME": ["c"]}}},
        {**BASE, "event_type": "flow", "flow": {"start": 1704067200, "end": 1704067200.25}},
        {**BASE, "event_type": "ssh", "ssh": {"client": {"software_version": "c"}, "server": None}},
        {**BASE, "event_type": "fileinfo", "fileinfo": {"size": 12}},
        {"event_type": "tls", "tls": {"sni": "x", "issuerdn": "i"}},
    )
    raw = read_events(spark, path)
    assert tuple(normalize.line_counts(raw).first()) == (13, 1, 1, 2, 9)
    rows = normalize.normalize_events(normalize.drop_flagged(raw)).withColumns(
        {c: F.unix_micros(c) for c in ("event_ts", "start_ts", "end_ts")}).collect()
    flow, h1, h2, d1, d2, numeric, ssh, info, tls = rows
    assert (flow.fwd_pkts, flow.bwd_bytes, flow.pkts, flow.bytes, flow.flow_id) == (3, 4, 3, 4, "7")
    assert flow.start_ts == flow.end_ts == flow.event_ts == 1704067201_500000
    assert (h1.http_status, h1.http_uri, h1.event_ts) == ("404", "", 1704067201_000000)
    assert (h2.http_status, h2.event_ts) == ("200", 1704067201_000000)
    assert (d1.src_ip, d1.dst_port, d1.dns_query, d1.dns_answers, d1.event_ts) == ("fe80::1", 0, "", [], None)
    assert d2.dns_answers == ["c", "1.2.3.4"]
    assert (numeric.start_ts, numeric.end_ts) == (1704067200_000000, 1704067200_250000)
    assert (ssh.ssh_client, ssh.ssh_server, info.file_size) == ("c", "", 12)
    assert (tls.flow_id, tls.tls_sni, tls.tls_issuer, tls.fwd_pkts) == ("None", "x", "i", None)


def test_ranges(spark):
    ips = ["104.15.255.255", "104.16.0.0", "104.31.255.255", "104.32.0.0", "::ffff:104.16.0.1", "104.16.0.300", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = [r[0] for r in df.select(in_range(F.col("ip"), "104.16.0.0/12")).collect()]
    assert got == [False, True, True, False, False, False, False]
    whole = df.select(in_range(F.col("ip"), "104.16.0.0/32"), in_range(F.col("ip"), "0.0.0.0/0")).collect()
    assert [r[0] for r in whole] == [False, True, False, False, False, False, False]
    assert [r[1] for r in whole] == [True, True, True, True, False, False, False]


def test_whitelist_cases(spark):
    cases = [  # dst_ip, port, proto, dropped
        ("8.8.8.8", 53, "UDP", True), ("8.8.8.8", 54, "UDP", False), ("192.0.2.1", 123, "UDP", True),
        ("192.0.2.1", 123, "SCTP", False), ("13.107.42.12", 443, "TCP", True), ("13.107.42.12", 80, "TCP", False),
        ("151.101.7.8", 80, "TCP", True), ("151.101.7.8", 81, "TCP", False), ("224.0.0.251", 5353, "UDP", True),
        ("224.0.0.5", 0, "IGMP", False), ("10.0.0.2", 9, "TCP", True), ("2001:db8::1", 53, "UDP", False),
        ("23.221.50.32", 443, "TCP", True), ("255.255.255.255", 67, "UDP", True),
    ]
    df = events(spark, [dict(event_type="flow", us=i, dst_ip=ip, dst_port=p, proto=q)
                        for i, (ip, p, q, _) in enumerate(cases)])
    df = df.union(df.limit(1).withColumns({"src_ip": F.lit("10.0.0.2"), "dst_ip": F.lit("10.9.9.9"), "seq": F.lit(99)}))
    trusted = TrustedServices(ntp_servers=("192.0.2.1",))
    want = {i for i, c in enumerate(cases) if not c[3]}
    assert {r.seq for r in whitelist.apply_whitelist(df, trusted).collect()} == want
    rules = whitelist.whitelist_rules(spark, trusted)
    kept = whitelist.drop_whitelisted(whitelist.drop_trusted_sources(df, trusted), rules)
    assert {r.seq for r in kept.collect()} == want


def test_additions_are_not_repeated(spark):
    t = TrustedServices().add_dns_server("8.8.8.8").add_known_service("13.107.42.12", 443)
    assert t == TrustedServices()
    t = t.add_dns_server("9.9.9.10").add_known_service("1.2.3.4", 8443)
    assert len(t.rows()) == len(TrustedServices().rows()) + 2
    rules = whitelist.whitelist_rules(spark)
    assert whitelist.extend_whitelist(rules, rules).count() == rules.count()
