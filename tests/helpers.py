"""Small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

T0 = 1_704_067_200_000_000
EVENT = (
    "event_type string, flow_id string, src_ip string, src_port int, dst_ip string, dst_port int, proto string, "
    "app_proto string, us bigint, seq bigint, start_us bigint, end_us bigint, fwd_pkts bigint, bwd_pkts bigint, "
    "fwd_bytes bigint, bwd_bytes bigint, state string, http_method string, http_status string, http_host string, "
    "http_uri string, http_user_agent string, dns_query string, dns_rrtype string, dns_answers array<string>, "
    "tls_sni string, tls_version string, tls_subject string, tls_issuer string, ssh_client string, ssh_server string"
)
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def events(spark, rows):
    """``rows`` are dicts with ``us`` relative to T0; the rest defaults."""
    base = dict(src_ip="10.0.0.1", src_port=1, dst_ip="10.1.0.1", dst_port=80, proto="TCP", flow_id="f")
    out = []
    for i, r in enumerate(rows):
        row = {**dict.fromkeys(NAMES), **base, "seq": i, **r}
        row["us"] += T0
        out.append(tuple(row[n] for n in NAMES))
    df = spark.createDataFrame(out, EVENT)
    return df.withColumns(
        {
            "event_ts": F.timestamp_micros("us"),
            "start_ts": F.timestamp_micros("start_us"),
            "end_ts": F.timestamp_micros("end_us"),
        }
    ).drop("us", "start_us", "end_us")


SESSION = (
    "flow_id string, session_no bigint, src_ip string, dst_ip string, dst_port int, proto string, app_proto string, "
    "state string, us bigint, total_fwd_packets bigint, total_bwd_packets bigint, total_fwd_bytes bigint, "
    "total_bwd_bytes bigint, http_event_count bigint, dns_event_count bigint, tls_event_count bigint, "
    "ssh_event_count bigint, http_status_codes array<string>, dns_answers array<string>, close_reason string"
)
SESSION_NAMES = [c.split()[0] for c in SESSION.split(", ")]


def session_rows(rows):
    base = dict(
        session_no=0, src_ip="10.0.0.1", dst_ip="10.1.0.1", dst_port=80, proto="TCP", app_proto="", state="closed",
        total_fwd_packets=0, total_bwd_packets=0, total_fwd_bytes=0, total_bwd_bytes=0, http_event_count=0,
        dns_event_count=0, tls_event_count=0, ssh_event_count=0, http_status_codes=[], dns_answers=[],
        close_reason="terminal",
    )
    return [{**base, "flow_id": str(i), **r} for i, r in enumerate(rows)]


def sessions(spark, rows):
    data = [tuple({**r, "us": r["us"] + T0}[n] for n in SESSION_NAMES) for r in session_rows(rows)]
    return spark.createDataFrame(data, SESSION).withColumn("close_ts", F.timestamp_micros("us")).drop("us")
