"""The registered queries: each operator over the network-shaped views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.functions.scalars import timestamp_of, timestamp_or_epoch
from wireloom.operators import alerts, behavior, features, models, normalize, prep, running, scoring, sessions
from wireloom.operators import trees, whitelist, zero_byte
from wireloom.operators.behavior import APP_COUNTERS, FEATURES, SLIDING
from wireloom.operators.features import BASE_FEATURES
from wireloom.operators.sessions import COUNTS, LISTS, SESSION_KEY
from wireloom.plans import batch, oracles as sql
from wireloom.plans.fixtures import flow_events, training_flows
from wireloom.sources.events import read_events, tail_events
from wireloom.sources.sinks import result_table
from wireloom.sources.staging import materialize, staging_path
from wireloom.sources.training import read_training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BURST_RATE = 0.02  # the fixture's empty flows are rarer than one a second


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            SQL[name] = oracle
        return build

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(flow_events(spark, sf_dir), "events")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = whitelist.apply_whitelist(_events(spark, sf_dir))
    return sessions.session_metrics(sessions.sessionize(kept))


def _us(column: str) -> F.Column:
    return F.unix_micros(column)


def _r(column: str, digits: int = 6) -> F.Column:
    return F.round(F.col(column).cast("double"), digits).alias(column)


def _rs(column: str, digits: int = 6) -> str:
    return f"round(CAST({column} AS DOUBLE), {digits}) AS {column}"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


# ---------------------------------------------------------------- events

EVENT_FIELDS = [
    "event_type", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "state",
    "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "http_method", "http_host", "http_uri",
    "http_status", "dns_query", "dns_rrtype", "tls_sni", "tls_version", "ssh_client",
]


#: Added where k = 0: no text, no object, a section that is none, nothing in it, an alert that is null.
ODD_LINES = [
    "",
    '[{"event_type": "flow", "flow_id": 1}]',
    '{"event_type": "flow", "flow_id": 2, "flow": "x"}',
    "{}",
    '{"event_type": "flow", "flow_id": 3, "alert": null}',
]


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture as sensor lines: flagged where k = 99, cut short where k = 98,
    of an unknown type where k = 97, mixed number and timestamp notations."""
    k = F.col("k")

    def only(event_type: str, *fields) -> F.Column:
        return F.when(F.col("event_type") == event_type, F.struct(*fields))

    stamp = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx")
    record = F.struct(
        F.when(k == 97, "stats").otherwise(F.col("event_type")).alias("event_type"),
        F.col("flow_id").cast("bigint").alias("flow_id"),
        "src_ip",
        "src_port",
        F.col("dst_ip").alias("dest_ip"),
        F.col("dst_port").alias("dest_port"),
        "proto",
        "app_proto",
        F.when(k % 2 == 0, stamp).otherwise(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("timestamp"),
        F.when(F.col("flagged"), F.struct(F.lit(1).alias("severity"))).alias("alert"),
        only(
            "flow",
            F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("start"),
            F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("end"),
            F.col("fwd_pkts").alias("pkts_toserver"),
            F.col("bwd_pkts").alias("pkts_toclient"),
            F.col("fwd_bytes").alias("bytes_toserver"),
            F.col("bwd_bytes").alias("bytes_toclient"),
            "state",
        ).alias("flow"),
        only(
            "http",
            "http_method",
            F.col("http_host").alias("hostname"),
            F.col("http_uri").alias("url"),
            F.col("http_status").cast("int").alias("status"),
        ).alias("http"),
        only(
            "dns",
            F.col("dns_query").alias("rrname"),
            F.col("dns_rrtype").alias("rrtype"),
            F.struct(
                F.slice("dns_answers", 1, 1).alias("CNAME"), F.slice("dns_answers", 2, 1).alias("A")
            ).alias("grouped"),
        ).alias("dns"),
        only("tls", F.col("tls_sni").alias("sni"), F.col("tls_version").alias("version")).alias("tls"),
        only("ssh", F.struct(F.col("ssh_client").alias("software_version")).alias("client")).alias("ssh"),
    )
    text = F.to_json(record)
    events = flow_events(spark, sf_dir)
    usual = events.select(F.when(k == 98, F.substring(text, 1, 40)).otherwise(text).alias("value"))
    odd = F.array(*[F.lit(x) for x in ODD_LINES])
    return usual.unionByName(events.filter("k = 0").select(F.get(odd, (F.col("seq") % len(ODD_LINES)).cast("int")).alias("value")))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "lines")
    event_lines(spark, sf_dir).write.text(path)
    return read_events(spark, path)


@query(
    "event_normalize",
    _with(
        sql.FE,
        f"""SELECT {', '.join(EVENT_FIELDS)}, coalesce(app_proto, '') AS app_proto, us,
        array_to_string(dns_answers, '|') AS dns_answers, start_us, end_us,
        fwd_pkts + bwd_pkts AS pkts, fwd_bytes + bwd_bytes AS bytes FROM fe WHERE k < 97""",
    ),
)
def _(spark, sf_dir):
    events = normalize.normalize_events(normalize.drop_flagged(_raw(spark, sf_dir)))
    return events.select(
        *EVENT_FIELDS,
        F.coalesce("app_proto", F.lit("")).alias("app_proto"),
        _us("event_ts").alias("us"),
        F.array_join("dns_answers", "|").alias("dns_answers"),
        _us("start_ts").alias("start_us"),
        _us("end_ts").alias("end_us"),
        "pkts",
        "bytes",
    )


@query(
    "line_counts",
    _with(
        sql.FE,
        """SELECT count(*) + count(*) FILTER (WHERE k = 0) AS total_entries,
        count(*) FILTER (WHERE k = 98 OR k = 0 AND seq % 5 < 3) AS malformed,
        count(*) FILTER (WHERE k = 99 OR k = 0 AND seq % 5 = 4) AS flagged,
        count(*) FILTER (WHERE k = 97 OR k = 0 AND seq % 5 = 3) AS ignored,
        count(*) FILTER (WHERE k < 97) AS processed_events FROM fe""",
    ),
)
def _(spark, sf_dir):
    return normalize.fate_counts(materialize(normalize.fated_events(_raw(spark, sf_dir)), "lines"))


@query("drop_flagged", _with(sql.FE, "SELECT flow_id, seq, us FROM fe WHERE NOT flagged"))
def _(spark, sf_dir):
    return flow_events(spark, sf_dir).withColumn("alert", F.when(F.col("flagged"), "x")).transform(
        normalize.drop_flagged
    ).select("flow_id", "seq", _us("event_ts").alias("us"))


@query(
    "timestamp_formats",
    _with(sql.BASE, "SELECT e, us AS iso_us, us AS mixed_us, us // 1000000 * 1000000 AS whole_us, CAST(NULL AS BIGINT) AS junk_us FROM base"),
)
def _(spark, sf_dir):
    ts = F.col("event_ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx")
    epoch = F.format_string("%d.%06d", F.expr("unix_micros(event_ts) div 1000000"), _us("event_ts") % 1_000_000)
    mixed = F.when(F.col("seq") % 2 == 0, epoch).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return flow_events(spark, sf_dir).select(
        F.col("seq").alias("e"),
        _us(timestamp_of(iso)).alias("iso_us"),
        _us(timestamp_or_epoch(mixed)).alias("mixed_us"),
        _us(timestamp_of(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxx"))).alias("whole_us"),
        _us(timestamp_of(F.concat(F.lit("no time "), iso))).alias("junk_us"),
    )


# ---------------------------------------------------------------- whitelist

EV_SELECT = "SELECT seq, flow_id, src_ip, dst_ip, dst_port FROM ev"


@query("whitelist_filter", _with(sql.EV, EV_SELECT))
def _(spark, sf_dir):
    return whitelist.apply_whitelist(_events(spark, sf_dir)).select("seq", "flow_id", "src_ip", "dst_ip", "dst_port")


@query("whitelist_rules_join", _with(sql.EV, EV_SELECT))
def _(spark, sf_dir):
    events = whitelist.drop_trusted_sources(_events(spark, sf_dir))
    return whitelist.drop_whitelisted(events, whitelist.whitelist_rules(spark)).select(
        "seq", "flow_id", "src_ip", "dst_ip", "dst_port"
    )


@query(
    "whitelist_extended",
    _with(sql.EV, "SELECT seq, dst_ip, dst_port FROM ev WHERE NOT (dst_ip = '192.168.0.1' AND dst_port = 22) AND NOT (dst_ip = '192.168.0.12' AND dst_port = 53)"),
)
def _(spark, sf_dir):
    extra = (
        whitelist.TrustedServices((), (), (), (), (), ())
        .add_known_service("192.168.0.1", 22)
        .add_dns_server("192.168.0.12")
    )
    rules = whitelist.extend_whitelist(
        whitelist.whitelist_rules(spark), whitelist.whitelist_rules(spark, extra)
    )
    events = whitelist.drop_trusted_sources(_events(spark, sf_dir))
    return whitelist.drop_whitelisted(events, rules).select("seq", "dst_ip", "dst_port")


# ---------------------------------------------------------------- sessions

SCALARS = [
    "flow_id", "session_no", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "app_proto", "state",
    "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes", *COUNTS, "close_reason",
]


@query(
    "sessionize",
    _with(sql.SESSIONS, f"SELECT {', '.join(SCALARS)}, start_us, end_us, last_us, close_us, flow_event_count < http_event_count + dns_event_count + tls_event_count + ssh_event_count + file_event_count + flow_event_count AS has_app_data FROM sess"),
)
def _(spark, sf_dir):
    return _sessions(spark, sf_dir).select(
        *SCALARS,
        _us("start_ts").alias("start_us"),
        _us("end_ts").alias("end_us"),
        _us("last_event_ts").alias("last_us"),
        _us("close_ts").alias("close_us"),
        "has_app_data",
    )


METRICS = ["duration", "flow_bytes_per_sec", "flow_packets_per_sec", "down_up_ratio"]


@query(
    "session_metrics",
    _with(sql.SESSIONS, f"SELECT flow_id, session_no, {', '.join(_rs(m, 3) for m in METRICS)} FROM sess"),
)
def _(spark, sf_dir):
    return _sessions(spark, sf_dir).select(*SESSION_KEY, *[_r(m, 3) for m in METRICS])


for _prefix in ("http", "dns", "tls", "ssh"):
    _names = [n for n in LISTS if n.startswith(_prefix)]

    def _build(spark, sf_dir, names=tuple(_names)):
        return _sessions(spark, sf_dir).select(*SESSION_KEY, *[F.array_join(n, "|").alias(n) for n in names])

    query(
        f"session_{_prefix}_lists",
        _with(sql.SESSIONS, f"SELECT flow_id, session_no, {', '.join(f'''array_to_string({n}, '|') AS {n}''' for n in _names)} FROM sess"),
    )(_build)

HAS_ERROR = "len(list_filter(http_status_codes, lambda c: c[1] IN ('4', '5'))) > 0"
LAYERS = "(CAST(http_event_count > 0 AS INTEGER) + CAST(dns_event_count > 0 AS INTEGER) + CAST(tls_event_count > 0 AS INTEGER) + CAST(ssh_event_count > 0 AS INTEGER))"


@query(
    "session_app_summary",
    _with(
        sql.SESSIONS,
        f"""SELECT flow_id, session_no, http_event_count, CAST(len(http_methods) AS INTEGER) AS unique_http_methods,
        {HAS_ERROR} AS has_http_error,
        list_contains(http_status_codes, '401') OR list_contains(http_status_codes, '407') AS has_http_auth,
        dns_event_count, CAST(len(dns_queries) AS INTEGER) AS unique_dns_queries,
        CAST(len(dns_answers) AS INTEGER) AS dns_answer_count, tls_event_count,
        CAST(len(tls_sni) AS INTEGER) AS tls_sni_count, ssh_event_count, file_event_count,
        {LAYERS} > 1 AS has_mixed_app_data FROM sess""",
    ),
)
def _(spark, sf_dir):
    return sessions.app_summary(_sessions(spark, sf_dir))


@query(
    "session_stats",
    _with(
        sql.SESSIONS,
        """SELECT count(*) AS total_sessions, count(*) FILTER (WHERE close_reason = 'flush') AS active_sessions,
        count(*) FILTER (WHERE close_reason <> 'flush') AS closed_sessions,
        count(*) FILTER (WHERE close_reason = 'timeout') AS expired_sessions,
        CAST(sum(flow_event_count) AS BIGINT) AS flow_events, CAST(sum(http_event_count) AS BIGINT) AS http_events,
        CAST(sum(dns_event_count) AS BIGINT) AS dns_events, CAST(sum(tls_event_count) AS BIGINT) AS tls_events,
        CAST(sum(ssh_event_count) AS BIGINT) AS ssh_events, CAST(sum(file_event_count) AS BIGINT) AS file_events FROM sess""",
    ),
)
def _(spark, sf_dir):
    return sessions.session_stats(_sessions(spark, sf_dir))


LOOKUP = ["flow_id", "session_no", "src_ip", "dst_port", "close_reason"]

for _name, _find, _value, _test in (
    ("sessions_by_flow", sessions.sessions_by_flow, "52", "flow_id = '52'"),
    ("sessions_by_ip", sessions.sessions_by_ip, "10.0.0.5", "src_ip = '10.0.0.5'"),
    ("sessions_by_dest_port", sessions.sessions_by_dest_port, 445, "dst_port = 445"),
):

    def _build(spark, sf_dir, find=_find, value=_value):
        return find(_sessions(spark, sf_dir), value).select(*LOOKUP)

    query(_name, _with(sql.SESSIONS, f"SELECT {', '.join(LOOKUP)} FROM sess WHERE {_test}"))(_build)


@query(
    "session_records",
    _with(sql.SESSIONS, "SELECT flow_id, session_no, src_ip, dst_port, total_fwd_bytes, array_to_string(http_uris, '|') AS http_uris FROM sess"),
)
def _(spark, sf_dir):
    schema = "src_ip string, dst_port int, total_fwd_bytes bigint, http_uris array<string>"
    return sessions.session_records(_sessions(spark, sf_dir)).select(
        *SESSION_KEY, F.from_json("record", schema).alias("r")
    ).select(*SESSION_KEY, "r.src_ip", "r.dst_port", "r.total_fwd_bytes", F.array_join("r.http_uris", "|").alias("http_uris"))


# ---------------------------------------------------------------- features

FLOW_SQL = f"""SELECT flow_id, session_no, CAST(dst_port AS BIGINT) AS dest_port, {_rs('duration')},
  total_fwd_packets, total_bwd_packets, total_fwd_bytes, total_bwd_bytes,
  {_rs('flow_bytes_per_sec', 3)}, {_rs('flow_packets_per_sec', 3)}, {_rs('down_up_ratio')},
  CAST(duration > 0 OR (start_us IS NOT NULL AND end_us IS NOT NULL) AS INTEGER) AS duration_known FROM sess"""


def _rounded_features(df: DataFrame, *extra: str) -> DataFrame:
    digits = {"duration": 6, "flow_bytes_per_sec": 3, "flow_packets_per_sec": 3, "down_up_ratio": 6}
    return df.select(
        *SESSION_KEY, *[_r(c, digits[c]) if c in digits else F.col(c) for c in BASE_FEATURES], *extra
    )


@query("flow_features", _with(sql.SESSIONS, FLOW_SQL))
def _(spark, sf_dir):
    return _rounded_features(features.flow_features(_sessions(spark, sf_dir)), "duration_known")


@query("flow_features_nested", _with(sql.SESSIONS, FLOW_SQL))
def _(spark, sf_dir):
    """The same features from records that keep counters and times in a nested object."""
    s = _sessions(spark, sf_dir)
    nested = s.select(
        *SESSION_KEY,
        F.col("dst_port").cast("string").alias("dest_port"),
        F.struct(
            F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("start"),
            F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("end"),
            F.col("total_fwd_packets").alias("pkts_toserver"),
            F.col("total_bwd_packets").alias("pkts_toclient"),
            F.col("total_fwd_bytes").cast("string").alias("bytes_toserver"),
            F.col("total_bwd_bytes").cast("string").alias("bytes_toclient"),
        ).alias("flow"),
    )
    return _rounded_features(features.flow_features(nested), "duration_known")


APP_SQL = f"""SELECT flow_id, session_no, http_event_count, CAST(http_event_count > 0 AS INTEGER) AS has_http,
  CAST(list_contains(http_methods, 'GET') AS INTEGER) AS has_http_get,
  CAST(list_contains(http_methods, 'POST') AS INTEGER) AS has_http_post,
  CAST(len(http_methods) AS INTEGER) AS http_method_count,
  CAST({HAS_ERROR} AS INTEGER) AS has_http_error,
  CAST(len(list_filter(http_status_codes, lambda c: c IN ('401', '403', '407'))) > 0 AS INTEGER) AS has_http_auth_error,
  dns_event_count, CAST(dns_event_count > 0 AS INTEGER) AS has_dns,
  CAST(len(dns_queries) AS INTEGER) AS dns_query_count, CAST(len(dns_answers) AS INTEGER) AS dns_answer_count,
  CAST(dns_event_count > 0 AND len(dns_answers) = 0 AS INTEGER) AS has_dns_failure,
  tls_event_count, CAST(tls_event_count > 0 AS INTEGER) AS has_tls, CAST(len(tls_sni) AS INTEGER) AS tls_sni_count,
  ssh_event_count, CAST(ssh_event_count > 0 AS INTEGER) AS has_ssh,
  CAST(state = 'rejected' AS INTEGER) AS is_rejected, CAST(state = 'established' AS INTEGER) AS is_established,
  CAST(state IN ('closed', 'fin') AS INTEGER) AS is_closed, CAST(state = 'rst' AS INTEGER) AS is_reset,
  {LAYERS} AS app_layer_count, CAST({LAYERS} > 1 AS INTEGER) AS has_mixed_protocols FROM sess"""


@query("app_features", _with(sql.SESSIONS, APP_SQL))
def _(spark, sf_dir):
    return features.app_features(_sessions(spark, sf_dir))


@query(
    "align_features",
    _with(sql.SESSIONS, "SELECT CAST(dst_port AS INTEGER) AS dest_port, 0 AS duration, total_fwd_bytes, flow_id, session_no FROM sess"),
)
def _(spark, sf_dir):
    s = _sessions(spark, sf_dir).select(*SESSION_KEY, "total_fwd_bytes", F.col("dst_port").alias("dest_port"))
    return features.align_features(s, ["dest_port", "duration", "total_fwd_bytes"])


@query(
    "hash_bucket",
    _with(
        sql.FE,
        "SELECT proto, CASE WHEN dst_ip = '' THEN 0 ELSE ('0x' || substr(md5(dst_ip), 1, 15))::BIGINT % 10000 END AS bucket, count(*) AS count FROM fe GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    from wireloom.functions.scalars import hash_bucket

    return flow_events(spark, sf_dir).groupBy("proto", hash_bucket(F.col("dst_ip")).alias("bucket")).count()


# ---------------------------------------------------------------- training data

TRAIN_SQL = [c for c in BASE_FEATURES]


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned feature rows with ``record_id`` and the binary ``label``."""
    raw = prep.infinite_to_null(prep.trim_headers(training_flows(spark, sf_dir)))
    rows = prep.binary_label(prep.impute_median(raw), "Label", "Label")
    return prep.select_features(rows, ["record_id", "Label"]).withColumnRenamed("Label", "label")


def _scaled(spark: SparkSession, sf_dir: str):
    rows = materialize(_training(spark, sf_dir), "training")
    scaler = prep.fit_scaler(rows, BASE_FEATURES)
    return prep.scale(rows, scaler), scaler


def _detector(spark: SparkSession, sf_dir: str) -> batch.Detector:
    scaled, scaler = _scaled(spark, sf_dir)
    return batch.Detector({}, scaler, prep.build_baseline(scaled.filter("label = 0"), BASE_FEATURES))


@query(
    "training_csv",
    _with(sql.BASE, f"SELECT count(*) AS n, CAST(sum(k * 1000 + e % 1000) AS BIGINT) AS duration, count(*) FILTER (WHERE event_type = 'error') AS attacks, count(*) FILTER (WHERE e % 2 = 0) AS with_note FROM base"),
)
def _(spark, sf_dir):
    """One folder of CSV files with different headers, read back and united by name."""
    rows = training_flows(spark, sf_dir)
    folder = staging_path(spark, "csv")
    rows.filter("record_id % 2 = 0").withColumn("note", F.lit("x")).write.option("header", True).csv(folder)
    turned = rows.filter("record_id % 2 = 1").select(*[F.col(f"`{c}`") for c in reversed(rows.columns)])
    turned.write.mode("append").option("header", True).csv(folder)
    back = prep.trim_headers(read_training(spark, folder))
    return back.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("Flow Duration")).cast("bigint").alias("duration"),
        F.count_if(F.col("Label") == "ATTACK").alias("attacks"),
        F.count("note").alias("with_note"),
    )


@query(
    "missing_counts",
    _with(
        sql.TR,
        " UNION ALL ".join(
            f"SELECT '{s}' AS \"column\", count(*) FILTER (WHERE {f} IS NULL) AS missing FROM tr"
            for s, f in prep.FEATURE_COLUMNS.items()
        ),
    ),
)
def _(spark, sf_dir):
    raw = prep.infinite_to_null(prep.trim_headers(training_flows(spark, sf_dir)))
    return prep.missing_counts(raw.select(*[F.col(f"`{c}`") for c in prep.FEATURE_COLUMNS]))


@query("impute_median", _with(sql.TR, f"SELECT record_id, label, {', '.join(_rs(c) for c in TRAIN_SQL)} FROM cl"))
def _(spark, sf_dir):
    return _training(spark, sf_dir).select("record_id", "label", *[_r(c) for c in TRAIN_SQL])


DUPES = """l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag
l_linestatus l_shipdate""".split()


@query("drop_duplicates", f"SELECT DISTINCT {', '.join(DUPES)} FROM lineitem")
def _(spark, sf_dir):
    return prep.drop_duplicate_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*DUPES))


@query(
    "duplicate_count",
    f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(DUPES)})""",
)
def _(spark, sf_dir):
    return prep.duplicate_count(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*DUPES))


@query(
    "label_report",
    _with(
        sql.TR,
        """SELECT count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS attack,
        round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS ratio,
        CASE WHEN count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) NOT BETWEEN 0.8 AND 1.2
             THEN 'imbalance' END AS warning FROM tr""",
    ),
)
def _(spark, sf_dir):
    rows = prep.binary_label(prep.trim_headers(training_flows(spark, sf_dir)))
    return prep.label_report(rows).withColumn("ratio", F.round("ratio", 6))


BALANCED = f""",
bal AS (SELECT record_id, label FROM (SELECT record_id, label, {sql.ranked('cl', 'label')} FROM cl)
        WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM cl GROUP BY label)))"""


@query("balance_classes", _with(sql.TR + BALANCED, "SELECT record_id, label FROM bal"))
def _(spark, sf_dir):
    rows = materialize(_training(spark, sf_dir), "training")
    return prep.balance_classes(rows, "record_id", "label").select("record_id", "label")


@query(
    "stratified_split",
    _with(
        sql.TR,
        f"""SELECT record_id, label, CASE WHEN rn <= ceil(0.75 * n) THEN 'train' ELSE 'test' END AS part
        FROM (SELECT record_id, label, {sql.ranked('cl', 'label')} FROM cl)""",
    ),
)
def _(spark, sf_dir):
    rows = materialize(_training(spark, sf_dir), "training")
    train, test = prep.stratified_split(rows, "record_id", "label")
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test"))).select(
        "record_id", "label", "part"
    )


@query(
    "stratified_folds",
    _with(sql.TR, f"SELECT record_id, label, CAST(rn % 3 AS INTEGER) AS fold FROM (SELECT record_id, label, {sql.ranked('cl', 'label')} FROM cl)"),
)
def _(spark, sf_dir):
    rows = materialize(_training(spark, sf_dir), "training")
    return models.stratified_folds(rows, "record_id", "label").select("record_id", "label", "fold")


@query(
    "label_encoding",
    _with(sql.TR, "SELECT record_id, CASE WHEN label = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label_index, CASE WHEN label = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS decoded FROM tr"),
)
def _(spark, sf_dir):
    rows = prep.trim_headers(training_flows(spark, sf_dir)).select("record_id", "Label")
    encoded, decoder = models.encode_labels(rows, "Label")
    return decoder.transform(encoded).select("record_id", "label_index", F.col("Label_decoded").alias("decoded"))


@query("scale", _with(sql.TR + sql.SCALER, f"SELECT record_id, label, {', '.join(_rs(c) for c in TRAIN_SQL)} FROM scl"))
def _(spark, sf_dir):
    scaled, _ = _scaled(spark, sf_dir)
    return scaled.select("record_id", "label", *[_r(c) for c in TRAIN_SQL])


STATS = ["mean", "std", "min", "max", "q1", "median", "q3", "iqr"]


@query("baseline", _with(sql.TR + sql.SCALER, f"SELECT feature, {', '.join(_rs(s) for s in STATS)} FROM bl"))
def _(spark, sf_dir):
    table = scoring.baseline_table(spark, _detector(spark, sf_dir).baseline)
    return table.select("feature", *[_r(s) for s in STATS])


# ---------------------------------------------------------------- scoring

SCORED = sql.with_training(sql.SESSIONS) + sql.stat_from("sess")


def _stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    detector = _detector(spark, sf_dir)
    rows = features.session_features(_sessions(spark, sf_dir))
    return scoring.score_statistical(rows, detector.baseline, detector.scaler)


@query("stat_score", _with(SCORED, f"SELECT flow_id, session_no, {_rs('score')}, is_anomalous FROM statv"))
def _(spark, sf_dir):
    return _stat(spark, sf_dir).select(
        *SESSION_KEY, F.round("stat.score", 6).alias("score"), F.col("stat.is_anomalous").alias("is_anomalous")
    )


@query(
    "stat_details",
    _with(
        SCORED,
        f"""SELECT flow_id, session_no, CAST(row_number() OVER (PARTITION BY flow_id, session_no ORDER BY abs(z) DESC, i) - 1 AS INTEGER) AS pos,
        feature, round(v, 6) AS value, round(z, 6) AS z_score, is_outlier, round(mean, 6) AS baseline_mean, round(std, 6) AS baseline_std
        FROM fz WHERE abs(z) > 3 OR is_outlier""",
    ),
)
def _(spark, sf_dir):
    d = _stat(spark, sf_dir).select(*SESSION_KEY, F.posexplode("stat.details").alias("pos", "d"))
    return d.select(
        *SESSION_KEY, "pos", "d.feature",
        F.round("d.value", 6).alias("value"), F.round("d.z_score", 6).alias("z_score"), "d.is_outlier",
        F.round("d.baseline_mean", 6).alias("baseline_mean"), F.round("d.baseline_std", 6).alias("baseline_std"),
    )


def _votes(events: DataFrame) -> DataFrame:
    """Model outputs that follow from the rows, to test the combination rules."""
    k = F.col("k")
    return events.select(
        F.col("seq").alias("id"),
        (k / 100.0).alias("dt_confidence"),
        ((k * 7 % 100) / 100.0).alias("rf_confidence"),
        ((k * 13 % 100) / 100.0).alias("gbt_confidence"),
        (k > 50).cast("int").alias("dt_prediction"),
        (k * 7 % 100 > 50).cast("int").alias("rf_prediction"),
        (k * 13 % 100 > 50).cast("int").alias("gbt_prediction"),
    )


@query(
    "ensemble_vote",
    _with(
        sql.BASE,
        """SELECT e AS id, round(k / 100.0 * 0.2 + (k * 7 % 100) / 100.0 * 0.3 + (k * 13 % 100) / 100.0 * 0.5, 6) AS score3,
        CAST(k > 50 AS INTEGER) + CAST(k * 7 % 100 > 50 AS INTEGER) + CAST(k * 13 % 100 > 50 AS INTEGER) >= 2 AS vote3,
        round(k / 100.0 * 0.4 + (k * 7 % 100) / 100.0 * 0.6, 6) AS score2,
        CAST(k > 50 AS INTEGER) + CAST(k * 7 % 100 > 50 AS INTEGER) >= 1 AS vote2 FROM base""",
    ),
)
def _(spark, sf_dir):
    votes = _votes(flow_events(spark, sf_dir))
    kept = votes.withColumns({"dtp": F.col("dt_prediction"), "dtc": F.col("dt_confidence"),
                              "rfp": F.col("rf_prediction"), "rfc": F.col("rf_confidence")})
    three = scoring.ensemble(kept).withColumnRenamed("ml", "ml3")
    two = scoring.ensemble(
        three.withColumnsRenamed({"dtp": "dt_prediction", "dtc": "dt_confidence", "rfp": "rf_prediction", "rfc": "rf_confidence"})
    )
    return two.select(
        "id", F.round("ml3.score", 6).alias("score3"), F.col("ml3.is_anomalous").alias("vote3"),
        F.round("ml.score", 6).alias("score2"), F.col("ml.is_anomalous").alias("vote2"),
    )


# ---------------------------------------------------------------- bursts

BURSTS = f""",
zb AS (SELECT flow_id, session_no, src_ip, dst_ip, dst_port, proto, close_us AS us,
         row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, proto ORDER BY close_us, flow_id, session_no) AS i
       FROM sess WHERE total_fwd_bytes + total_bwd_bytes = 0 AND dst_port > 0 AND close_reason <> 'flush'),
walk AS (
  SELECT *, us AS first_us, 1 AS c, false AS fired, 0 AS shown, 0.0::DOUBLE AS rate FROM zb WHERE i = 1
  UNION ALL
  SELECT z.flow_id, z.session_no, z.src_ip, z.dst_ip, z.dst_port, z.proto, z.us, z.i, y.first_us,
    CASE WHEN y.n >= 3 AND y.n * 1000000.0 / y.span > {BURST_RATE} THEN 0 ELSE y.n END,
    y.n >= 3 AND y.n * 1000000.0 / y.span > {BURST_RATE}, y.n, y.n * 1000000.0 / y.span
  FROM (SELECT w.src_ip, w.dst_ip, w.dst_port, w.proto, z2.i,
          CASE WHEN z2.us - w.us > 600000000 THEN z2.us ELSE w.first_us END AS first_us,
          CASE WHEN z2.us - w.us > 600000000 THEN 1 ELSE w.c + 1 END AS n,
          CASE WHEN z2.us - w.us > 600000000 OR z2.us = w.first_us THEN 100000 ELSE z2.us - w.first_us END AS span
        FROM walk w JOIN zb z2 ON z2.src_ip = w.src_ip AND z2.dst_ip = w.dst_ip AND z2.dst_port = w.dst_port
          AND z2.proto = w.proto AND z2.i = w.i + 1) y
  JOIN zb z ON z.src_ip = y.src_ip AND z.dst_ip = y.dst_ip AND z.dst_port = y.dst_port AND z.proto = y.proto AND z.i = y.i)"""


@query(
    "zero_byte_bursts",
    _with(
        "RECURSIVE " + (sql.SESSIONS + BURSTS).strip(),
        "SELECT flow_id, session_no, src_ip, dst_ip, dst_port, proto, us AS close_us, CAST(shown AS BIGINT) AS zero_byte_count, round(rate, 6) AS zero_byte_rate FROM walk WHERE fired",
    ),
)
def _(spark, sf_dir):
    s = materialize(_sessions(spark, sf_dir), "sessions")
    closed = s.filter("close_reason <> 'flush'")
    return zero_byte.zero_byte_bursts(closed, max_rate=BURST_RATE).withColumn(
        "zero_byte_rate", F.round("zero_byte_rate", 6)
    )


HOT_RATES = ["0.02", "0.7", "1", "3"]
HOT_COMPRESSION = 1000  # 30 days become 2,592 seconds


def _hot_bursts(rate: str) -> str:
    """The counter walked flow by flow, in whole numbers."""
    whole, _, decimals = rate.partition(".")
    num, den = int(whole + decimals), 10 ** len(decimals)
    fires = f"y.n >= 3 AND y.n * 1000000 * {den} > y.span * {num}"
    return f"""
walk AS (
  SELECT dst_ip, i, us, flow_id, us AS first_us, CAST(1 AS BIGINT) AS c, false AS fired, CAST(0 AS BIGINT) AS shown FROM zb WHERE i = 1
  UNION ALL
  SELECT y.dst_ip, y.i, y.us, y.flow_id, y.first_us, CASE WHEN {fires} THEN 0 ELSE y.n END, {fires}, y.n
  FROM (SELECT z.dst_ip, z.i, z.us, z.flow_id,
          CASE WHEN z.us - w.us > 600000000 THEN z.us ELSE w.first_us END AS first_us,
          CASE WHEN z.us - w.us > 600000000 THEN 1 ELSE w.c + 1 END AS n,
          CASE WHEN z.us - w.us > 600000000 OR z.us = w.first_us THEN 100000 ELSE z.us - w.first_us END AS span
        FROM walk w JOIN zb z ON z.dst_ip = w.dst_ip AND z.i = w.i + 1) y)
SELECT '{rate}' AS rate, flow_id, dst_ip, us AS close_us, shown AS zero_byte_count FROM walk WHERE fired"""


HOT_ROWS = f"""
zb AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY us, flow_id) AS i FROM (
  SELECT CAST(event_id AS VARCHAR) AS flow_id,
    CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'host' || CAST(user_id AS VARCHAR) END AS dst_ip,
    epoch_us(ts) // {HOT_COMPRESSION} AS us FROM events))"""


@query(
    "burst_hot_key",
    " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {HOT_ROWS.strip()}, {_hot_bursts(r).strip()})" for r in HOT_RATES),
)
def _(spark, sf_dir):
    """A third of all events at one endpoint, at rates that divide a second and rates that don't."""
    hot = F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("host"), F.col("user_id")))
    us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div {HOT_COMPRESSION}")
    flows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("flow_id"),
        F.lit(0).cast("bigint").alias("session_no"),
        F.lit("10.0.0.1").alias("src_ip"),
        hot.alias("dst_ip"),
        F.lit(80).alias("dst_port"),
        F.lit("TCP").alias("proto"),
        F.timestamp_micros(us).alias("close_ts"),
        F.lit(0).cast("bigint").alias("total_fwd_bytes"),
        F.lit(0).cast("bigint").alias("total_bwd_bytes"),
    )
    found = None
    for rate in HOT_RATES:
        bursts = zero_byte.zero_byte_bursts(flows, max_rate=rate).select(
            F.lit(rate).alias("rate"), "flow_id", "dst_ip", "close_us", "zero_byte_count"
        )
        found = bursts if found is None else found.unionByName(bursts)
    return found


# ---------------------------------------------------------------- behaviour

BEHAVIOR = sql.SESSIONS + sql.points() + sql.TIMELINE
SCORE_NAMES = behavior.SCORES


def _timeline(spark, sf_dir, lifetime=True, include_timeout=False) -> DataFrame:
    return behavior.behavior_timeline(_sessions(spark, sf_dir), lifetime=lifetime, include_timeout=include_timeout)


def _scored(spark, sf_dir, **options) -> DataFrame:
    return behavior.behavior_scores(_timeline(spark, sf_dir, **options))


IP_TOTALS = ["total_flows", "bytes_sent", "bytes_received", "packets_sent", "packets_received", "unique_dst_ips", "unique_dst_ports", *APP_COUNTERS]


@query(
    "ip_totals",
    _with(
        sql.SESSIONS + sql.points(),
        f"""SELECT src_ip, count(*) AS total_flows, count(*) FILTER (WHERE state IN ('closed', 'established', 'fin', 'rst')) AS completed_flows,
        CAST(sum(total_fwd_bytes) AS BIGINT) AS bytes_sent, CAST(sum(total_bwd_bytes) AS BIGINT) AS bytes_received, CAST(sum(total_fwd_packets) AS BIGINT) AS packets_sent,
        CAST(sum(total_bwd_packets) AS BIGINT) AS packets_received, count(DISTINCT dst_ip) AS unique_dst_ips,
        count(DISTINCT CASE WHEN dst_port > 0 THEN dst_port END) AS unique_dst_ports,
        {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in APP_COUNTERS)} FROM pts GROUP BY src_ip""",
    ),
)
def _(spark, sf_dir):
    return behavior.ip_totals(_sessions(spark, sf_dir))


@query(
    "ip_totals_all",
    _with(
        sql.SESSIONS + sql.points("'terminal', 'timeout'"),
        """SELECT src_ip, count(*) AS total_flows, count(*) FILTER (WHERE state IN ('closed', 'established', 'fin', 'rst')) AS completed_flows
        FROM pts GROUP BY src_ip""",
    ),
)
def _(spark, sf_dir):
    """Timed-out sessions included: flows seen, and those of them that were completed."""
    totals = behavior.ip_totals(_sessions(spark, sf_dir), include_timeout=True)
    return totals.select("src_ip", "total_flows", "completed_flows")


@query(
    "ip_histograms",
    _with(
        sql.SESSIONS + sql.points(),
        " UNION ALL ".join(
            f"SELECT src_ip, '{kind}' AS kind, {c} AS value, count(*) AS n FROM pts WHERE coalesce({c}, '') <> '' GROUP BY ALL"
            for kind, c in (("protocols", "proto"), ("app_protocols", "app_proto"), ("connection_states", "state"))
        ),
    ),
)
def _(spark, sf_dir):
    maps = behavior.ip_histograms(_sessions(spark, sf_dir))
    kinds = ["protocols", "app_protocols", "connection_states"]
    wide = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in kinds])
    return maps.select("src_ip", F.explode(wide).alias("x")).select(
        "src_ip", "x.kind", F.explode("x.m").alias("value", "n")
    )


@query(
    "sliding_distinct",
    _with(BEHAVIOR, "SELECT flow_id, session_no, src_ip, close_us, ips_in_window, ports_in_window FROM tl"),
)
def _(spark, sf_dir):
    return _timeline(spark, sf_dir, lifetime=False).select(*SESSION_KEY, "src_ip", "close_us", "ips_in_window", "ports_in_window")


@query("sliding_volume", _with(BEHAVIOR, "SELECT flow_id, session_no, bytes_in_window, packets_in_window FROM tl"))
def _(spark, sf_dir):
    return _timeline(spark, sf_dir, lifetime=False).select(*SESSION_KEY, "bytes_in_window", "packets_in_window")


ALL_CLOSED = sql.SESSIONS + sql.points("'terminal', 'timeout'") + sql.TIMELINE


@query("auth_failures", _with(ALL_CLOSED, "SELECT flow_id, session_no, max_auth_failures FROM tl"))
def _(spark, sf_dir):
    return _timeline(spark, sf_dir, lifetime=False, include_timeout=True).select(*SESSION_KEY, "max_auth_failures")


@query("behavior_scores", _with(BEHAVIOR, f"SELECT flow_id, session_no, {', '.join(_rs(s) for s in SCORE_NAMES)} FROM sc"))
def _(spark, sf_dir):
    return _scored(spark, sf_dir, lifetime=False).select(*SESSION_KEY, *[_r(s) for s in SCORE_NAMES])


FEATURE_DIGITS = {"flow_rate": 3, "bytes_sent_per_second": 2, "packets_sent_per_second": 3}


@query(
    "behavior_features",
    _with(ALL_CLOSED, f"SELECT flow_id, session_no, src_ip, close_us, {', '.join(_rs(f, FEATURE_DIGITS.get(f, 4)) for f in FEATURES)} FROM bf"),
)
def _(spark, sf_dir):
    vectors = behavior.behavior_features(_scored(spark, sf_dir, include_timeout=True))
    return vectors.select(*SESSION_KEY, "src_ip", "close_us", *[_r(f, FEATURE_DIGITS.get(f, 4)) for f in FEATURES])


@query(
    "activity_epochs",
    _with(
        sql.SESSIONS + sql.points("'terminal', 'timeout'") + """,
st AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, flow_id, session_no) > 100000000 THEN 1 ELSE 0 END AS o FROM pts),
ep AS (SELECT *, CAST(sum(o) OVER (PARTITION BY src_ip ORDER BY us RANGE UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM st)""",
        "SELECT src_ip, epoch, min(us) AS epoch_start, count(*) AS flows FROM ep GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    points = materialize(behavior.observed_sessions(_sessions(spark, sf_dir), True), "points")
    gap, width = 100_000_000, 30_000_000
    epochs = running.activity_epochs(points, ["src_ip"], "us", gap, width)
    placed = points.withColumn(running.CHUNK, running.chunk_start(F.col("us"), width)).join(
        epochs, ["src_ip", running.CHUNK]
    )
    return placed.groupBy("src_ip", "epoch").agg(
        F.min("epoch_start").alias("epoch_start"), F.count(F.lit(1)).alias("flows")
    )


@query(
    "suspicious_sessions",
    _with(BEHAVIOR, f"SELECT flow_id, session_no, src_ip, {_rs('overall_anomaly_score')} FROM sc WHERE overall_anomaly_score > 0.5"),
)
def _(spark, sf_dir):
    return behavior.suspicious(_scored(spark, sf_dir, lifetime=False)).select(
        *SESSION_KEY, "src_ip", _r("overall_anomaly_score")
    )


@query(
    "top_ips",
    _with(BEHAVIOR, f"SELECT src_ip, {_rs('overall_anomaly_score')} FROM latest ORDER BY latest.overall_anomaly_score DESC, src_ip LIMIT 10"),
)
def _(spark, sf_dir):
    latest = behavior.latest_scores(_scored(spark, sf_dir, lifetime=False))
    return behavior.top_anomalous_ips(latest, 10).select("src_ip", _r("overall_anomaly_score"))


@query(
    "scan_activity",
    _with(
        BEHAVIOR,
        """SELECT src_ip, round(CASE WHEN port_scan_score > 0.2 THEN port_scan_score ELSE host_scan_score END, 6) AS scan_score,
        CASE WHEN port_scan_score > 0.2 THEN 'port_scan' ELSE 'host_scan' END AS scan_type
        FROM latest WHERE port_scan_score > 0.2 OR host_scan_score > 0.2""",
    ),
)
def _(spark, sf_dir):
    latest = behavior.latest_scores(_scored(spark, sf_dir, lifetime=False))
    return behavior.scan_activity(latest, 0.2).withColumn("scan_score", F.round("scan_score", 6))


@query(
    "brute_force_activity",
    _with(ALL_CLOSED, f"SELECT src_ip, {_rs('brute_force_score')} FROM latest WHERE brute_force_score > 0.15"),
)
def _(spark, sf_dir):
    latest = behavior.latest_scores(_scored(spark, sf_dir, lifetime=False, include_timeout=True))
    return behavior.brute_force_activity(latest, 0.15).select("src_ip", _r("brute_force_score"))


@query(
    "ip_profile",
    _with(BEHAVIOR, f"SELECT flow_id, session_no, close_us, total_flows, unique_dst_ips, {_rs('overall_anomaly_score')} FROM sc WHERE src_ip = '10.0.0.4'"),
)
def _(spark, sf_dir):
    return behavior.ip_behavior(_scored(spark, sf_dir), "10.0.0.4").select(
        *SESSION_KEY, "close_us", "total_flows", "unique_dst_ips", _r("overall_anomaly_score")
    )


@query(
    "analyzer_stats",
    _with(BEHAVIOR, "SELECT count(*) AS tracked_ips, count(*) FILTER (WHERE overall_anomaly_score > 0.5) AS anomalous_ips FROM latest"),
)
def _(spark, sf_dir):
    return behavior.analyzer_stats(behavior.latest_scores(_scored(spark, sf_dir, lifetime=False)))


@query(
    "status_report",
    _with(BEHAVIOR, f"SELECT src_ip, {_rs('overall_anomaly_score')} FROM (SELECT * FROM latest ORDER BY overall_anomaly_score DESC, src_ip LIMIT 5) WHERE overall_anomaly_score > 0.3"),
)
def _(spark, sf_dir):
    latest = behavior.latest_scores(_scored(spark, sf_dir, lifetime=False))
    return batch.status_report(latest, 0.3).select("src_ip", _r("overall_anomaly_score"))


# ---------------------------------------------------------------- results and alerts

RESULTS = (
    "RECURSIVE "
    + (
        sql.with_training(sql.SESSIONS)
        + sql.stat_from("(SELECT * FROM sess WHERE close_reason <> 'flush')")
        + BURSTS
        + sql.points()
        + sql.TIMELINE
        + """,
res0 AS (
  SELECT s.*, w.flow_id IS NOT NULL AS burst, w.shown, w.rate,
    CASE WHEN w.flow_id IS NOT NULL THEN 0.8 ELSE t.score END AS score0,
    w.flow_id IS NOT NULL OR t.is_anomalous AS anomalous0, t.score AS raw_score,
    b.overall_anomaly_score AS overall,
    b.port_scan_score, b.host_scan_score, b.brute_force_score, b.volume_anomaly_score
  FROM sess s JOIN statv t USING (flow_id, session_no)
    LEFT JOIN (SELECT * FROM walk WHERE fired) w USING (flow_id, session_no)
    LEFT JOIN (SELECT * FROM bf WHERE overall_anomaly_score > 0.5) b USING (flow_id, session_no)),
res AS (
  SELECT *, score0 < 0.8 AND coalesce(overall > 0.7, false) AS escalated,
    CASE WHEN score0 < 0.8 AND coalesce(overall > 0.7, false) THEN 0.8 ELSE score0 END AS combined_score,
    anomalous0 OR (score0 < 0.8 AND coalesce(overall > 0.7, false)) AS is_anomalous
  FROM res0)"""
    ).strip()
)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    detector = _detector(spark, sf_dir)
    _, _, results = batch.analyze_events(_events(spark, sf_dir), detector, burst_rate=BURST_RATE)
    return results


@query(
    "escalate",
    _with(
        RESULTS,
        """SELECT flow_id, session_no, round(combined_score, 6) AS combined_score, is_anomalous, escalated,
        CASE WHEN escalated AND NOT anomalous0 THEN 'behavior' WHEN is_anomalous THEN 'score' END AS alert_reason FROM res""",
    ),
)
def _(spark, sf_dir):
    return _results(spark, sf_dir).select(
        *SESSION_KEY, F.round("combined_score", 6).alias("combined_score"), "is_anomalous", "escalated", "alert_reason"
    )


@query(
    "result_rows",
    _with(
        RESULTS,
        """SELECT close_us AS us, flow_id, src_ip, src_port, dst_ip, dst_port, proto, app_proto,
        round(CASE WHEN burst THEN 0 ELSE duration END, 6) AS duration,
        CASE WHEN burst THEN 0 ELSE total_fwd_bytes + total_bwd_bytes END AS bytes,
        CASE WHEN burst THEN 0 ELSE total_fwd_packets + total_bwd_packets END AS packets,
        CASE WHEN burst THEN 0.8 ELSE 0.0 END::DOUBLE AS ml_score, round(score0, 6) AS stat_score,
        round(combined_score, 6) AS combined_score, CAST(is_anomalous AS INTEGER) AS is_anomalous FROM res""",
    ),
)
def _(spark, sf_dir):
    table = result_table(_results(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("duration", "ml_score", "stat_score", "combined_score")}
    return table.withColumns(rounded).withColumn("us", _us("timestamp")).drop("timestamp")


@query(
    "detection_stats",
    _with(
        RESULTS,
        """SELECT count(*) AS processed_sessions,
        count(*) FILTER (WHERE total_fwd_bytes + total_bwd_bytes = 0) AS zero_byte_sessions,
        count(*) FILTER (WHERE duration < 0.1 AND NOT burst) AS short_duration_sessions,
        count(*) FILTER (WHERE NOT burst) AS analyzed_sessions,
        count(*) FILTER (WHERE NOT burst AND anomalous0) AS anomalous_sessions,
        count(*) FILTER (WHERE anomalous0) AS alerts_generated FROM res""",
    ),
)
def _(spark, sf_dir):
    return scoring.detection_stats(_results(spark, sf_dir), 0.1)


@query(
    "run_summary",
    _with(
        RESULTS,
        """SELECT (SELECT count(*) + count(*) FILTER (WHERE k = 0) FROM fe) AS total_entries,
        (SELECT count(*) FROM fe WHERE k = 99 OR k = 0 AND seq % 5 = 4) AS flagged,
        (SELECT count(*) FROM fe WHERE k < 97) AS processed_events,
        count(*) AS finalized_sessions, count(*) FILTER (WHERE is_anomalous) AS anomalies_detected FROM res""",
    ),
)
def _(spark, sf_dir):
    return batch.run_summary(normalize.line_counts(_raw(spark, sf_dir)), materialize(
        _results(spark, sf_dir).select("is_anomalous"), "verdicts"))


def _hint_sql() -> str:
    cases = [f"WHEN proto = 'ICMP' THEN '{alerts.HINT_ICMP}'"]
    for ports, text in alerts.HINT_BY_PORT.items():
        cases.append(f"WHEN dst_port IN ({', '.join(map(str, ports))}) THEN '{text}'")
    return (
        "CASE " + " ".join(cases) + f" WHEN dst_port < 1024 THEN '{alerts.HINT_LOW_PORT}' "
        f"WHEN dst_port > 49000 THEN '{alerts.HINT_HIGH_PORT}' ELSE '{alerts.HINT_OTHER}' END"
    )


@query("threat_hint", _with(sql.FE, f"SELECT seq, {_hint_sql()} AS hint FROM fe"))
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", alerts.threat_hint(F.col("proto"), F.col("dst_port")).alias("hint"))


def _num(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {expr})"


def _join_sql(name: str, count: str, values: str) -> str:
    return f"CASE WHEN {count} > 0 AND len({values}) > 0 THEN '{name}: ' || array_to_string({values}, ', ') || chr(10) ELSE '' END"


def _events_sql(name: str, count: str) -> str:
    return f"CASE WHEN {count} > 0 THEN '{name}: ' || {count} || chr(10) ELSE '' END"


CONNECTION_SQL = """'Endpoints' || chr(10) || 'from address: ' || src_ip || chr(10) || 'from port: ' || src_port || chr(10)
  || 'to address: ' || dst_ip || chr(10) || 'to port: ' || dst_port || chr(10) || 'transport: ' || proto || chr(10)
  || CASE WHEN app_proto <> '' THEN 'application: ' || app_proto || chr(10) ELSE '' END"""
GROUPED_SQL = "format('{:,}', CAST(%s AS BIGINT))"


@query(
    "alert_sections",
    _with(
        RESULTS,
        f"""SELECT flow_id, session_no, {CONNECTION_SQL} AS connection,
        {_events_sql('http requests', 'http_event_count')} || {_join_sql('http verbs', 'http_event_count', 'http_methods')}
        || {_join_sql('http answers', 'http_event_count', 'http_status_codes')} || {_events_sql('dns lookups', 'dns_event_count')}
        || {_join_sql('dns names', 'dns_event_count', 'dns_queries[1:3]')} || {_events_sql('tls handshakes', 'tls_event_count')}
        || {_join_sql('tls names', 'tls_event_count', 'tls_sni')} AS app,
        'Volume' || chr(10) || 'bytes in all: ' || {GROUPED_SQL % 'CASE WHEN burst THEN 0 ELSE total_fwd_bytes + total_bwd_bytes END'} || chr(10)
        || '  sent: ' || {GROUPED_SQL % 'total_fwd_bytes'} || ' bytes' || chr(10)
        || '  received: ' || {GROUPED_SQL % 'total_bwd_bytes'} || ' bytes' || chr(10)
        || 'packets in all: ' || {GROUPED_SQL % 'CASE WHEN burst THEN 0 ELSE total_fwd_packets + total_bwd_packets END'} || chr(10)
        || '  sent: ' || {GROUPED_SQL % 'total_fwd_packets'} || ' packets' || chr(10)
        || '  received: ' || {GROUPED_SQL % 'total_bwd_packets'} || ' packets' || chr(10)
        || 'closed as: ' || state AS traffic,
        'It may mean' || chr(10) || '  • ' || {_hint_sql()}
        || CASE WHEN port_scan_score > 0.5 THEN chr(10) || '  • {alerts.BEHAVIOR_HINTS['port_scan_score']}' ELSE '' END
        || CASE WHEN host_scan_score > 0.5 THEN chr(10) || '  • {alerts.BEHAVIOR_HINTS['host_scan_score']}' ELSE '' END
        || CASE WHEN brute_force_score > 0.5 THEN chr(10) || '  • {alerts.BEHAVIOR_HINTS['brute_force_score']}' ELSE '' END
        || CASE WHEN volume_anomaly_score > 0.5 THEN chr(10) || '  • {alerts.BEHAVIOR_HINTS['volume_anomaly_score']}' ELSE '' END
        || CASE WHEN burst THEN chr(10) || '  • {alerts.HINT_ZERO_BYTE}' ELSE '' END AS hints
        FROM res WHERE is_anomalous""",
    ),
)
def _(spark, sf_dir):
    ended = lambda c: F.coalesce(F.concat(c, F.lit("\n")), F.lit(""))
    return _results(spark, sf_dir).filter("is_anomalous").select(
        *SESSION_KEY,
        ended(alerts.connection_section()).alias("connection"),
        ended(alerts.app_section()).alias("app"),
        alerts.traffic_section().alias("traffic"),
        alerts.hints_section(True).alias("hints"),
    )


@query(
    "alert_short",
    _with(
        RESULTS + """,
top3 AS (SELECT flow_id, session_no, string_agg('- ' || feature || ': ' || round(v, 3) || ' (z ' || printf('%.2f', round(z, 2)) || ')', chr(10) ORDER BY rk) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, session_no ORDER BY abs(z) DESC, i) AS rk FROM fz WHERE abs(z) > 3 OR is_outlier) WHERE rk <= 3 GROUP BY ALL)""",
        f"""SELECT flow_id, session_no, '{alerts.TITLE}' || chr(10) || chr(10) || 'seen at: ' || strftime(make_timestamp(close_us), '%Y-%m-%d %H:%M:%S') || chr(10)
        || repeat('-', 40) || chr(10) || {CONNECTION_SQL} || chr(10) || 'score: ' || printf('%.4f', round(combined_score, 4)) || chr(10)
        || CASE WHEN t IS NULL OR burst THEN '' ELSE chr(10) || 'Unusual values' || chr(10) || t || chr(10) END
        || chr(10) || 'written for ' || strftime(make_timestamp(close_us), '%Y-%m-%d %H:%M:%S') AS message
        FROM res LEFT JOIN top3 USING (flow_id, session_no) WHERE is_anomalous""",
    ),
)
def _(spark, sf_dir):
    """Short alerts; values are rounded first so that both sides print the same digits."""
    results = _results(spark, sf_dir)
    details = F.transform(
        "stat.details",
        lambda d: d.withField("value", F.round(d["value"], 3)).withField("z_score", F.round(d["z_score"], 2)),
    )
    rounded = results.withColumn("stat", F.col("stat").withField("details", details)).withColumn(
        "combined_score", F.round("combined_score", 4)
    )
    return alerts.render_alerts(rounded, "short").select(*SESSION_KEY, "message")


@query("alert_text")
def _(spark, sf_dir):
    return alerts.render_alerts(_results(spark, sf_dir)).select(*SESSION_KEY, "alert_reason", "message")


@query(
    "alert_log",
    _with(
        RESULTS,
        """SELECT flow_id, session_no, src_ip, dst_ip, http_event_count AS http_events, dns_event_count AS dns_events,
        tls_event_count AS tls_events, round(combined_score, 6) AS combined_score, burst AS zero_byte_pattern,
        round(CASE WHEN port_scan_score > 0.5 THEN port_scan_score END, 6) AS port_scan_score,
        round(overall, 6) AS overall_anomaly_score FROM res WHERE is_anomalous""",
    ),
)
def _(spark, sf_dir):
    return alerts.alert_log(_results(spark, sf_dir)).select(
        *SESSION_KEY, "src_ip", "dst_ip", "http_events", "dns_events", "tls_events",
        _r("combined_score"), "zero_byte_pattern", _r("port_scan_score"), _r("overall_anomaly_score"),
    )


# ---------------------------------------------------------------- models

PREDICTED = """,
pr AS (SELECT record_id, label, CAST(flow_packets_per_sec > 12 OR record_id % 7 = 0 AS INTEGER) AS prediction FROM cl)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (F.col("flow_packets_per_sec") > 12) | (F.col("record_id") % 7 == 0)
    return _training(spark, sf_dir).select("record_id", "label", rule.cast("int").alias("prediction"))


@query(
    "confusion_matrix",
    _with(
        sql.TR + PREDICTED,
        "SELECT label, count(*) FILTER (WHERE prediction = 0) AS predicted_0, count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM pr GROUP BY label",
    ),
)
def _(spark, sf_dir):
    return models.confusion_matrix(_predicted(spark, sf_dir), "label")


@query(
    "classification_report",
    _with(
        sql.TR + PREDICTED + """,
pc AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS hit, count(*) FILTER (WHERE label = c) AS support,
         count(*) FILTER (WHERE prediction = c) AS predicted FROM pr, (VALUES (0), (1)) v(c) GROUP BY c),
pm AS (SELECT c, support, hit, hit / predicted AS precision, hit / support AS recall, 2.0 * hit / (predicted + support) AS f1 FROM pc)""",
        """SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pm
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pm
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
          round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pm
        UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pm""",
    ),
)
def _(spark, sf_dir):
    report = models.classification_report(_predicted(spark, sf_dir), "label")
    return report.select("class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support")


@query("model_scores")
def _(spark, sf_dir):
    """Train the models on the labelled view and score the sessions with them."""
    from wireloom.plans import training

    raw = training_flows(spark, sf_dir).drop("record_id")
    trained = training.train(raw)
    rows = features.session_features(_sessions(spark, sf_dir))
    scored = batch.score_features(rows, trained.detector)
    return scored.select(
        *SESSION_KEY,
        F.round("ml.score", 6).alias("ml_score"),
        "ml.dt_prediction",
        "ml.rf_prediction",
        "ml.gbt_prediction",
        F.round("combined_score", 6).alias("combined_score"),
        "is_anomalous",
    )


@query("feature_importance")
def _(spark, sf_dir):
    scaled, _ = _scaled(spark, sf_dir)
    vectors = models.assemble(scaled, BASE_FEATURES)
    model = models.train_decision_tree(vectors, "label")
    return models.feature_importances(model, BASE_FEATURES).withColumn("importance", F.round("importance", 6))


@query("grid_search")
def _(spark, sf_dir):
    """Cross-validated grid over boosted trees, macro F1 per combination."""
    scaled, _ = _scaled(spark, sf_dir)
    vectors = models.assemble(scaled, BASE_FEATURES)
    return models.tune_boosted_trees(vectors, "record_id", "label").scores.select(
        F.col("depth").alias("max_depth"), F.col("rounds").alias("max_iter"), F.col("step").alias("step_size"), "macro_f1"
    )


# --- fixed values: a small forest over three of the base features; leaves have feature -1 ---
# tree, weight, node, feature, threshold, left, right, value, gain, rows
FOREST = [
    (0, 1.0, 0, 0, 100.0, 1, 2, 0.0, 0.30, 900.0),
    (0, 1.0, 1, 6, 2500.0, 3, 4, 0.0, 0.10, 500.0),
    (0, 1.0, 2, -1, 0.0, -1, -1, 0.9, 0.0, 400.0),
    (0, 1.0, 3, -1, 0.0, -1, -1, 0.125, 0.0, 300.0),
    (0, 1.0, 4, -1, 0.0, -1, -1, 0.75, 0.0, 200.0),
    (1, 1.0, 0, 8, 1.5, 1, 2, 0.0, 0.05, 900.0),
    (1, 1.0, 1, -1, 0.0, -1, -1, 0.2, 0.0, 450.0),
    (1, 1.0, 2, 0, 440.0, 3, 4, 0.0, 0.20, 450.0),
    (1, 1.0, 3, -1, 0.0, -1, -1, 0.55, 0.0, 250.0),
    (1, 1.0, 4, -1, 0.0, -1, -1, 1.0, 0.0, 200.0),
    (2, 1.0, 0, -1, 0.0, -1, -1, 0.5, 0.0, 900.0),
]
FOREST_SQL = """nodes(tree, weight, node, feature, threshold, l, r, value, gain, n) AS (VALUES
    (0, 1.0, 0, 0, 100.0, 1, 2, 0.0, 0.30, 900.0), (0, 1.0, 1, 6, 2500.0, 3, 4, 0.0, 0.10, 500.0),
    (0, 1.0, 2, -1, 0.0, -1, -1, 0.9, 0.0, 400.0), (0, 1.0, 3, -1, 0.0, -1, -1, 0.125, 0.0, 300.0),
    (0, 1.0, 4, -1, 0.0, -1, -1, 0.75, 0.0, 200.0), (1, 1.0, 0, 8, 1.5, 1, 2, 0.0, 0.05, 900.0),
    (1, 1.0, 1, -1, 0.0, -1, -1, 0.2, 0.0, 450.0), (1, 1.0, 2, 0, 440.0, 3, 4, 0.0, 0.20, 450.0),
    (1, 1.0, 3, -1, 0.0, -1, -1, 0.55, 0.0, 250.0), (1, 1.0, 4, -1, 0.0, -1, -1, 1.0, 0.0, 200.0),
    (2, 1.0, 0, -1, 0.0, -1, -1, 0.5, 0.0, 900.0))"""


@query(
    "tree_scores",
    _with(
        sql.TR + f""",
{FOREST_SQL},
steps AS (
    SELECT record_id, tree, CASE WHEN feature < 0 THEN 0 WHEN CASE feature WHEN 0 THEN dest_port WHEN 6 THEN flow_bytes_per_sec ELSE down_up_ratio END
        <= threshold THEN l ELSE r END AS a, value
    FROM cl, nodes WHERE node = 0),
deeper AS (
    SELECT s.record_id, s.tree, CASE WHEN n.feature < 0 THEN n.node WHEN CASE n.feature WHEN 0 THEN dest_port WHEN 6 THEN flow_bytes_per_sec
        ELSE down_up_ratio END <= n.threshold THEN n.l ELSE n.r END AS b
    FROM steps s JOIN cl USING (record_id) JOIN nodes n ON n.tree = s.tree AND n.node = s.a)""",
        """SELECT d.record_id, round(CAST(avg(n.value) AS DOUBLE), 9) AS rf_confidence, CAST(avg(n.value) > 0.5 AS INTEGER) AS rf_prediction
        FROM deeper d JOIN nodes n ON n.tree = d.tree AND n.node = d.b GROUP BY d.record_id""",
    ),
)
def _(spark, sf_dir):
    """A table of nodes, scored by expressions over every training row."""
    forest = trees.compile_nodes(spark.createDataFrame(FOREST, trees.NODES), booster=False)
    scored = trees.predict(_training(spark, sf_dir), forest, [F.col(c) for c in BASE_FEATURES], "rf")
    return scored.select("record_id", F.round("rf_confidence", 9).alias("rf_confidence"), "rf_prediction")


def _append(folder: str):
    """Appends a task's lines to the log of its part, as a sensor does."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        where.create_dir(base, recursive=True)
        with where.open_append_stream(f"{base}/part-{TaskContext.get().partitionId()}.json") as file:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    file.write(line.encode() + b"\n")
        yield from ()

    return run


@query(
    "stream_tail",
    _with(
        sql.FE,
        """SELECT event_type, flow_id, src_ip, src_port, dst_ip, dst_port, proto, us, fwd_bytes + bwd_bytes AS bytes FROM fe WHERE k < 97""",
    ),
)
def _(spark, sf_dir):
    """Logs that grow three times, read as they grow; tasks append to them, each to its own."""
    logs, out, state = (staging_path(spark, n) for n in ("tail-logs", "tail-out", "tail-state"))
    lines = materialize(event_lines(spark, sf_dir), "tail-lines")
    parts = lines.repartition(4, "value")
    for n in range(3):
        some = parts.filter(F.pmod(F.xxhash64("value"), F.lit(3)) == n)
        some.mapInArrow(_append(logs), "value string").write.format("noop").mode("overwrite").save()
        events = normalize.normalize_events(normalize.drop_flagged(tail_events(spark, logs)))
        writer = events.writeStream.format("parquet").option("checkpointLocation", state)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    done = spark.read.schema(events.schema).parquet(out)
    fields = ["event_type", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto"]
    return done.select(*fields, _us("event_ts").alias("us"), "bytes")


STREAM_SQL = sql.EV + sql.sessions()


@query(
    "stream_sessions",
    _with(
        STREAM_SQL,
        f"""SELECT flow_id, session_no, {', '.join(c for c in SCALARS if c not in ('flow_id', 'session_no', 'close_reason'))},
        array_to_string(http_uris, '|') AS http_uris, array_to_string(dns_answers, '|') AS dns_answers,
        start_us, end_us, CASE WHEN last_terminal THEN 'terminal' ELSE 'timeout' END AS close_reason,
        CASE WHEN last_terminal THEN last_us ELSE last_us + 120000000 END AS close_us FROM sess""",
    ),
)
def _(spark, sf_dir):
    """The events as a stream of files in time order, closed by a last far-off event."""
    from wireloom.streaming.sessions import EVENT_COLUMNS, stream_sessions

    events = whitelist.apply_whitelist(_events(spark, sf_dir)).select(*EVENT_COLUMNS)
    source = staging_path(spark, "stream")
    last = events.agg(F.max(_us("event_ts")).alias("us")).first()["us"]
    end = events.orderBy("seq").limit(1).withColumns(
        {
            "event_ts": F.timestamp_micros(F.lit(last + 86_400_000_000)),
            "flow_id": F.lit("end"),
            "event_type": F.lit("fileinfo"),
        }
    )
    cut = F.floor((_us("event_ts") - 1_704_067_200_000_000) / 220_000_000)
    bounds = events.agg(F.min(cut).alias("low"), F.max(cut).alias("high")).first()
    for i in range(bounds["low"], bounds["high"] + 1):
        events.filter(cut == i).coalesce(1).write.mode("append").parquet(source)
    end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = staging_path(spark, "stream-out")
    run = (
        stream_sessions(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", staging_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    closed = spark.read.parquet(out).filter("flow_id <> 'end'")
    return closed.select(
        *SCALARS,
        F.array_join("http_uris", "|").alias("http_uris"),
        F.array_join("dns_answers", "|").alias("dns_answers"),
        _us("start_ts").alias("start_us"),
        _us("end_ts").alias("end_us"),
        _us("close_ts").alias("close_us"),
    )
