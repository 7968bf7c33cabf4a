"""The registered queries restated as SQL over the same tables."""

from __future__ import annotations

import ipaddress

from wireloom.operators.behavior import APP_COUNTERS, FEATURES
from wireloom.operators.features import BASE_FEATURES
from wireloom.operators.prep import FEATURE_COLUMNS
from wireloom.operators.sessions import LISTS
from wireloom.operators.whitelist import TrustedServices

BASE = """
base AS (
  SELECT event_id AS e, user_id AS uid, user_id % 10 AS u,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_type,
         CAST(round(value * 100) AS BIGINT) AS cents,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 4000 AS us
  FROM events)"""

PORTS = "[22, 23, 53, 80, 139, 443, 445, 3389, 8080, 50000]"

FE = BASE + f""",
fe0 AS (
  SELECT CASE event_type WHEN 'error' THEN 'flow' WHEN 'click' THEN 'http' WHEN 'view' THEN 'dns'
              WHEN 'purchase' THEN 'tls' ELSE 'ssh' END AS event_type,
    CAST(uid * 10 + e % 4 AS VARCHAR) AS flow_id,
    '10.0.' || (uid // 256) || '.' || (uid % 256) AS src_ip,
    CAST(40000 + e % 20000 AS INTEGER) AS src_port,
    CASE WHEN u = 4 THEN '192.168.1.' || k WHEN u IN (3, 5, 6) THEN '192.168.0.1'
         WHEN k < 3 THEN '8.8.8.8' WHEN k < 5 THEN '151.101.1.' || k
         WHEN k < 6 THEN '224.0.0.251' ELSE '192.168.0.' || (k % 20) END AS dst_ip,
    CAST(CASE WHEN u = 3 THEN 1000 + e % 5000 WHEN u = 4 THEN 445 WHEN u IN (5, 6) THEN 22
         WHEN k < 3 THEN 53 ELSE {PORTS}[k % 10 + 1] END AS INTEGER) AS dst_port,
    us, e AS seq, k, u, cents, event_type AS et0
  FROM base),
fe AS (
  SELECT event_type, flow_id, src_ip, src_port, dst_ip, dst_port,
    CASE WHEN dst_port = 53 THEN 'UDP' ELSE 'TCP' END AS proto,
    CASE WHEN event_type = 'flow' THEN ([NULL, 'http', 'dns', 'tls', 'ssh'])[k % 5 + 1] END AS app_proto,
    us, seq, k, k = 99 AS flagged,
    CASE WHEN event_type = 'flow' THEN us - k * 10000 END AS start_us,
    CASE WHEN event_type = 'flow' THEN us END AS end_us,
    CASE WHEN event_type = 'flow' THEN CAST(CASE WHEN u = 6 THEN 0 ELSE 1 + k % 7 END AS BIGINT) END AS fwd_pkts,
    CASE WHEN event_type = 'flow' THEN CAST(CASE WHEN u = 6 THEN 0 ELSE k % 5 END AS BIGINT) END AS bwd_pkts,
    CASE WHEN event_type = 'flow' THEN CAST(CASE WHEN u = 6 THEN 0 WHEN u = 9 THEN cents * 10000 ELSE cents END AS BIGINT) END AS fwd_bytes,
    CASE WHEN event_type = 'flow' THEN CAST(CASE WHEN u = 6 THEN 0 ELSE cents * (k % 5) END AS BIGINT) END AS bwd_bytes,
    CASE WHEN event_type = 'flow' THEN CASE WHEN k < 40 THEN 'closed' WHEN k < 55 THEN 'established' WHEN k < 62 THEN 'rst'
         WHEN k < 65 THEN 'fin' WHEN k < 75 THEN 'rejected' ELSE 'new' END END AS state,
    CASE WHEN event_type = 'http' THEN (['GET', 'POST', 'PUT'])[k % 3 + 1] END AS http_method,
    CASE WHEN event_type = 'http' THEN 'h' || (k % 4) END AS http_host,
    CASE WHEN event_type = 'http' THEN '/p/' || (k % 9) END AS http_uri,
    CAST(NULL AS VARCHAR) AS http_user_agent,
    CASE WHEN event_type = 'http' THEN CASE WHEN u = 5 AND k < 70 THEN '401' WHEN k < 80 THEN '200'
         WHEN k < 90 THEN '404' ELSE '500' END END AS http_status,
    CASE WHEN event_type = 'dns' THEN 'q' || (k % 6) END AS dns_query,
    CASE WHEN event_type = 'dns' THEN 'A' END AS dns_rrtype,
    CASE WHEN event_type = 'dns' THEN CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[])
         ELSE ['a' || (k % 5), 'b' || (k % 3)] END END AS dns_answers,
    CASE WHEN event_type = 'tls' THEN 's' || (k % 5) END AS tls_sni,
    CASE WHEN event_type = 'tls' THEN (['TLS 1.2', 'TLS 1.3'])[k % 2 + 1] END AS tls_version,
    CAST(NULL AS VARCHAR) AS tls_subject, CAST(NULL AS VARCHAR) AS tls_issuer,
    CASE WHEN event_type = 'ssh' THEN 'c' || (k % 3) END AS ssh_client,
    CAST(NULL AS VARCHAR) AS ssh_server
  FROM fe0)"""


def _ip_number(ip: str) -> str:
    parts = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    return f"((({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]})"


def _bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net[0]), int(net[-1])


def _whitelisted() -> str:
    tests = []
    for _, address, port, proto in TrustedServices().rows():
        if "/" in address:
            low, high = _bounds(address)
            test = f"{_ip_number('dst_ip')} BETWEEN {low} AND {high}"
        else:
            test = f"dst_ip = '{address}'"
        if port is not None:
            test += f" AND dst_port = {port}"
        tests.append(f"({test})")
    return "(dst_port > 0 AND (" + " OR ".join(tests) + "))"


EV = FE + f""",
ev AS (SELECT * FROM fe WHERE src_ip <> '10.0.0.2' AND NOT {_whitelisted()})"""

GAP = 120_000_000
TERMINAL = "('closed', 'established', 'fin', 'rst')"


def numbered(source: str, gap: int = GAP) -> str:
    return f""",
term AS (SELECT *, event_type = 'flow' AND coalesce(state IN {TERMINAL}, false) AS terminal FROM {source}),
lagged AS (SELECT *, lag(us) OVER w AS pus, lag(terminal) OVER w AS pterm FROM term
           WINDOW w AS (PARTITION BY flow_id ORDER BY us, seq)),
numbered AS (SELECT *, CAST(sum(CASE WHEN pterm OR us - pus > {gap} THEN 1 ELSE 0 END) OVER
             (PARTITION BY flow_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM lagged)"""


def _lists() -> str:
    parts = []
    for name, column in LISTS.items():
        if column == "dns_answers":
            parts.append(
                "SELECT flow_id, session_no, 'dns_answers' AS kind, a.v AS value, us, seq, a.pos FROM numbered, "
                "LATERAL (SELECT unnest(dns_answers) AS v, unnest(range(len(dns_answers))) AS pos) a"
            )
        else:
            parts.append(f"SELECT flow_id, session_no, '{name}' AS kind, {column} AS value, us, seq, 0 AS pos FROM numbered")
    picks = ",\n".join(
        f"coalesce(list(value ORDER BY us, seq, pos) FILTER (WHERE kind = '{n}'), CAST([] AS VARCHAR[])) AS {n}" for n in LISTS
    )
    return f""",
vals AS ({' UNION ALL '.join(parts)}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY flow_id, session_no, kind, value ORDER BY us, seq, pos) AS rn
           FROM vals WHERE coalesce(value, '') <> ''),
lists AS (SELECT flow_id, session_no, {picks} FROM firsts WHERE rn = 1 GROUP BY ALL)"""


def _counts() -> str:
    names = {"flow": "flow", "http": "http", "dns": "dns", "tls": "tls", "ssh": "ssh", "file": "fileinfo"}
    return ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {n}_event_count" for n, t in names.items())


def sessions(source: str = "ev", gap: int = GAP) -> str:
    pick_lists = ", ".join(f"coalesce(l.{n}, CAST([] AS VARCHAR[])) AS {n}" for n in LISTS)
    return numbered(source, gap) + _lists() + f""",
grouped AS (
  SELECT flow_id, session_no,
    first(src_ip ORDER BY us, seq) AS src_ip, first(src_port ORDER BY us, seq) AS src_port,
    first(dst_ip ORDER BY us, seq) AS dst_ip, first(dst_port ORDER BY us, seq) AS dst_port,
    first(proto ORDER BY us, seq) AS proto,
    coalesce(last(app_proto ORDER BY us, seq) FILTER (WHERE event_type = 'flow' AND coalesce(app_proto, '') <> ''),
             first(event_type ORDER BY us, seq) FILTER (WHERE event_type IN ('http', 'dns', 'tls', 'ssh')), '') AS app_proto,
    least(min(start_us) FILTER (WHERE event_type = 'flow'),
          CASE WHEN first(event_type ORDER BY us, seq) <> 'flow' THEN min(us) END) AS start_us,
    max(end_us) FILTER (WHERE event_type = 'flow') AS end_us,
    coalesce(last(state ORDER BY us, seq) FILTER (WHERE event_type = 'flow'), '') AS state,
    coalesce(last(fwd_pkts ORDER BY us, seq) FILTER (WHERE event_type = 'flow'), 0) AS total_fwd_packets,
    coalesce(last(bwd_pkts ORDER BY us, seq) FILTER (WHERE event_type = 'flow'), 0) AS total_bwd_packets,
    coalesce(last(fwd_bytes ORDER BY us, seq) FILTER (WHERE event_type = 'flow'), 0) AS total_fwd_bytes,
    coalesce(last(bwd_bytes ORDER BY us, seq) FILTER (WHERE event_type = 'flow'), 0) AS total_bwd_bytes,
    {_counts()},
    last(terminal ORDER BY us, seq) AS last_terminal, max(us) AS last_us
  FROM numbered GROUP BY flow_id, session_no),
sess0 AS (
  SELECT g.*, {pick_lists},
    CASE WHEN last_terminal THEN 'terminal'
         WHEN (SELECT max(us) FROM {source}) - last_us > {gap} THEN 'timeout' ELSE 'flush' END AS close_reason
  FROM grouped g LEFT JOIN lists l USING (flow_id, session_no)),
sess AS (
  SELECT *, CASE close_reason WHEN 'terminal' THEN last_us WHEN 'timeout' THEN last_us + {gap}
              ELSE (SELECT max(us) FROM {source}) END AS close_us,
    coalesce((end_us - start_us) / 1000000.0, 0.0) AS duration,
    (total_fwd_bytes + total_bwd_bytes) / greatest(coalesce((end_us - start_us) / 1000000.0, 0.0), 0.001) AS flow_bytes_per_sec,
    (total_fwd_packets + total_bwd_packets) / greatest(coalesce((end_us - start_us) / 1000000.0, 0.0), 0.001) AS flow_packets_per_sec,
    CASE WHEN total_fwd_bytes > 0 THEN total_bwd_bytes / total_fwd_bytes ELSE 0.0 END AS down_up_ratio
  FROM sess0)"""


SESSIONS = EV + sessions()


def points(states: str = "'terminal'") -> str:
    return f""",
pts AS (
  SELECT flow_id, session_no, src_ip, dst_ip, coalesce(dst_port, 0) AS dst_port, proto, app_proto, state, close_us AS us,
    total_fwd_bytes, total_bwd_bytes, total_fwd_packets, total_bwd_packets,
    http_event_count AS http_requests,
    len(list_filter(http_status_codes, lambda c: c[1] IN ('4', '5'))) AS http_errors,
    dns_event_count AS dns_queries,
    CAST(dns_event_count > 0 AND len(dns_answers) = 0 AS BIGINT) AS dns_failures,
    tls_event_count AS tls_handshakes,
    CAST(tls_event_count > 0 AND state IN ('rejected', 'failed') AS BIGINT) AS tls_failures,
    ssh_event_count AS ssh_attempts,
    len(list_filter(http_status_codes, lambda c: c IN ('401', '403', '407')))
      + CAST(ssh_event_count > 0 AND state IN ('rejected', 'failed') AS BIGINT) AS auth_failures,
    CASE WHEN coalesce(app_proto, '') <> '' THEN app_proto ELSE proto || '-' || dst_port END AS service
  FROM sess WHERE close_reason IN ({states}))"""


WINDOW_US = 300_000_000

TIMELINE = f""",
stepped AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, flow_id, session_no) > {WINDOW_US} THEN 1 ELSE 0 END AS opened
  FROM pts),
epoched AS (
  SELECT *, CAST(sum(opened) OVER (PARTITION BY src_ip ORDER BY us RANGE UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM stepped),
services AS (
  SELECT p.flow_id, p.session_no, q.service, sum(q.auth_failures) AS n
  FROM pts p JOIN pts q ON p.src_ip = q.src_ip AND q.us <= p.us AND q.us > p.us - {WINDOW_US} AND q.auth_failures > 0
  GROUP BY ALL),
worst AS (SELECT flow_id, session_no, max(n) AS n FROM services GROUP BY ALL),
windowed AS (
  SELECT p.flow_id, p.session_no,
    count(DISTINCT q.dst_ip) AS ips_in_window,
    count(DISTINCT CASE WHEN q.dst_port > 0 THEN q.dst_port END) AS ports_in_window,
    CAST(sum(q.total_fwd_bytes) AS BIGINT) AS bytes_in_window,
    CAST(sum(q.total_fwd_packets) AS BIGINT) AS packets_in_window
  FROM pts p JOIN pts q ON p.src_ip = q.src_ip AND q.us <= p.us AND q.us > p.us - {WINDOW_US}
  GROUP BY ALL),
lifetime AS (
  SELECT p.flow_id, p.session_no, p.epoch, min(q.us) AS epoch_start, count(*) AS total_flows,
    count(*) FILTER (WHERE q.state = 'rejected') AS rejected_flows,
    count(*) FILTER (WHERE q.state = 'rst') AS reset_flows,
    count(DISTINCT q.dst_ip) AS unique_dst_ips,
    count(DISTINCT CASE WHEN q.dst_port > 0 THEN q.dst_port END) AS unique_dst_ports,
    {', '.join(f'CAST(sum(q.{c}) AS BIGINT) AS total_{c}' for c in APP_COUNTERS)}
  FROM epoched p JOIN epoched q ON p.src_ip = q.src_ip AND p.epoch = q.epoch AND q.us <= p.us
  GROUP BY ALL),
tl AS (
  SELECT p.flow_id, p.session_no, p.src_ip, p.us AS close_us, w.* EXCLUDE (flow_id, session_no),
    CAST(coalesce(x.n, 0) AS BIGINT) AS max_auth_failures, l.* EXCLUDE (flow_id, session_no)
  FROM pts p JOIN windowed w USING (flow_id, session_no) LEFT JOIN worst x USING (flow_id, session_no)
    JOIN lifetime l USING (flow_id, session_no)),
sc0 AS (
  SELECT *,
    CASE WHEN ips_in_window > 0 AND ports_in_window / ips_in_window > 10 THEN least(1.0, ports_in_window / ips_in_window / 50.0) ELSE 0.0 END AS port_scan_score,
    CASE WHEN ports_in_window > 0 AND ips_in_window / ports_in_window > 5 THEN least(1.0, ips_in_window / ports_in_window / 20.0) ELSE 0.0 END AS host_scan_score,
    CASE WHEN max_auth_failures > 3 THEN least(1.0, max_auth_failures / 20.0) ELSE 0.0 END AS brute_force_score,
    greatest(
      CASE WHEN bytes_in_window / 300.0 > 1000000 THEN least(1.0, bytes_in_window / 300.0 / 10000000.0) ELSE 0.0 END,
      CASE WHEN packets_in_window / 300.0 > 1000 THEN least(1.0, packets_in_window / 300.0 / 10000.0) ELSE 0.0 END) AS volume_anomaly_score
  FROM tl),
sc AS (
  SELECT *, greatest(port_scan_score, host_scan_score) AS scan_score,
    greatest(port_scan_score, host_scan_score, brute_force_score, volume_anomaly_score) AS overall_anomaly_score
  FROM sc0),
ft AS (
  SELECT *, CASE WHEN least((close_us - epoch_start) / 1000000.0, 300.0) <= 0 THEN 0.001
            ELSE least((close_us - epoch_start) / 1000000.0, 300.0) END AS secs FROM sc),
bf AS (
  SELECT flow_id, session_no, src_ip, close_us,
    total_flows / secs AS flow_rate, 1.0 AS complete_flow_ratio, unique_dst_ips, unique_dst_ports,
    ips_in_window / secs AS dst_ips_per_second, ports_in_window / secs AS dst_ports_per_second,
    bytes_in_window / secs AS bytes_sent_per_second, packets_in_window / secs AS packets_sent_per_second,
    total_http_errors / greatest(total_http_requests, 1) AS http_error_ratio,
    total_dns_failures / greatest(total_dns_queries, 1) AS dns_failure_ratio,
    total_tls_failures / greatest(total_tls_handshakes, 1) AS tls_failure_ratio,
    total_auth_failures / secs AS auth_failures_per_second,
    rejected_flows / greatest(total_flows, 1) AS rejected_ratio,
    reset_flows / greatest(total_flows, 1) AS reset_ratio,
    port_scan_score, host_scan_score, brute_force_score, volume_anomaly_score, overall_anomaly_score
  FROM ft),
latest AS (
  SELECT src_ip, max(close_us) AS last_seen_us,
    {', '.join(f'last({c} ORDER BY close_us, flow_id, session_no) AS {c}' for c in ('port_scan_score', 'host_scan_score', 'scan_score', 'brute_force_score', 'volume_anomaly_score', 'overall_anomaly_score'))}
  FROM sc GROUP BY src_ip)"""

BEHAVIOR = SESSIONS + points("'terminal', 'timeout'") + TIMELINE

# --- training records ---

TR = BASE + f""",
tr AS (
  SELECT e AS record_id,
    CAST({PORTS}[k % 10 + 1] AS DOUBLE) AS dest_port,
    CAST(k * 1000 + e % 1000 AS DOUBLE) AS duration,
    CAST(1 + k % 7 AS DOUBLE) AS total_fwd_packets, CAST(k % 5 AS DOUBLE) AS total_bwd_packets,
    CAST(cents AS DOUBLE) AS total_fwd_bytes, CAST(cents * (k % 5) AS DOUBLE) AS total_bwd_bytes,
    CASE WHEN k % 20 IN (0, 1) THEN NULL ELSE cents / 10.0 END AS flow_bytes_per_sec,
    CASE WHEN k % 20 = 2 THEN NULL ELSE (k + e % 10) / 4.0 END AS flow_packets_per_sec,
    CAST(k % 5 AS DOUBLE) AS down_up_ratio,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM base),
med AS (SELECT median(flow_bytes_per_sec) AS b, median(flow_packets_per_sec) AS p FROM tr),
cl AS (
  SELECT tr.* REPLACE (coalesce(flow_bytes_per_sec, (SELECT b FROM med)) AS flow_bytes_per_sec,
                       coalesce(flow_packets_per_sec, (SELECT p FROM med)) AS flow_packets_per_sec) FROM tr)"""


def ranked(source: str, label: str) -> str:
    return f"""row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST(record_id AS VARCHAR) || ':42'), record_id) AS rn,
      count(*) OVER (PARTITION BY {label}) AS n"""


SCALER = """,
sclr AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS feature, avg({c}) AS m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s FROM cl"
    for i, c in enumerate(BASE_FEATURES)
) + """),
scl AS (""" + "SELECT record_id, label, " + ", ".join(
    f"({c} - (SELECT m FROM sclr WHERE feature = '{c}')) / (SELECT s FROM sclr WHERE feature = '{c}') AS {c}" for c in BASE_FEATURES
) + """ FROM cl),
bl AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
    quantile_cont({c}, 0.25) AS q1, median({c}) AS median, quantile_cont({c}, 0.75) AS q3,
    quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM scl WHERE label = 0"""
    for c in BASE_FEATURES
) + ")"

FEATURE_VALUES = {**{c: c for c in BASE_FEATURES}, "dest_port": "dst_port"}
WHOLE = {
    "dest_port": "true", "total_fwd_packets": "true", "total_bwd_packets": "true",
    "total_fwd_bytes": "true", "total_bwd_bytes": "true",
    "duration": "(duration <= 0 AND (end_us IS NULL OR start_us IS NULL))",
    "down_up_ratio": "total_fwd_bytes <= 0",
}


def stat_from(source: str) -> str:
    """Statistical results of a session relation."""
    rows = " UNION ALL ".join(
        f"SELECT flow_id, session_no, {i} AS i, '{c}' AS feature, CAST({FEATURE_VALUES[c]} AS DOUBLE) AS x, {WHOLE.get(c, 'false')} AS whole FROM {source}"
        for i, c in enumerate(BASE_FEATURES)
    )
    return f""",
fx AS ({rows}),
fv AS (SELECT f.flow_id, f.session_no, f.i, f.feature, b.mean, b.std, b.q1, b.q3, b.iqr,
         CASE WHEN whole THEN round_even((x - m) / s, 0) ELSE (x - m) / s END AS v
       FROM fx f JOIN sclr c USING (feature) JOIN bl b USING (feature)),
fz AS (SELECT *, CASE WHEN std > 0 THEN (v - mean) / std ELSE 0.0 END AS z,
         iqr > 0 AND (v < q1 - 1.5 * iqr OR v > q3 + 1.5 * iqr) AS is_outlier FROM fv),
stat AS (
  SELECT flow_id, session_no,
    sum(CASE WHEN abs(z) > 4 OR is_outlier THEN (CASE WHEN abs(z) > 0 THEN abs(z) ELSE 1.0 END)
        * CASE feature WHEN 'flow_bytes_per_sec' THEN 0.8 WHEN 'dest_port' THEN 1.2 ELSE 1.0 END ELSE 0.0 END) / 9.0 AS score,
    count(*) FILTER (WHERE abs(z) > 4) AS extreme
  FROM fz GROUP BY ALL),
statv AS (SELECT *, score > 0.7 OR extreme >= 2 AS is_anomalous FROM stat)"""


def with_training(cte: str) -> str:
    """Session CTEs next to training CTEs (which share ``base``)."""
    return cte + TR[len(BASE):] + SCALER
