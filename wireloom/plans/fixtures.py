"""Network-shaped views over the ``events`` table.

Pure projections: every row of ``events`` becomes one sensor event or one
labelled flow record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01, the start of the events table
COMPRESSION = 4000  # 30 days become 648 seconds
EVENT_TYPES = {"error": "flow", "click": "http", "view": "dns", "purchase": "tls", "signup": "ssh"}
PORTS = [22, 23, 53, 80, 139, 443, 445, 3389, 8080, 50000]
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, ts)"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("uid"),
        (F.col("user_id") % 10).alias("u"),
        # props is always {"k": <int>}; cutting it is cheaper than parsing it where filters repeat it
        F.expr("cast(substring(props, 7, length(props) - 7) as int)").alias("k"),
        F.col("event_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.expr(f"{ORIGIN_US} + ({micros} - {ORIGIN_US}) div {COMPRESSION}").alias("us"),
    )


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised sensor events plus ``flagged`` (already matched by a signature)."""
    u, k, e = F.col("u"), F.col("k"), F.col("e")
    et = F.coalesce(
        *[F.when(F.col("event_type") == a, F.lit(b)) for a, b in EVENT_TYPES.items()]
    )
    dst_ip = (
        F.when(u == 4, F.concat(F.lit("192.168.1."), k))
        .when(u.isin(3, 5, 6), F.lit("192.168.0.1"))
        .when(k < 3, F.lit("8.8.8.8"))
        .when(k < 5, F.concat(F.lit("151.101.1."), k))
        .when(k < 6, F.lit("224.0.0.251"))
        .otherwise(F.concat(F.lit("192.168.0."), k % 20))
    )
    dst_port = (
        F.when(u == 3, (1000 + e % 5000).cast("int"))
        .when(u == 4, F.lit(445))
        .when(u.isin(5, 6), F.lit(22))
        .when(k < 3, F.lit(53))
        .otherwise(_pick(PORTS, k % 10))
    )
    state = (
        F.when(k < 40, "closed").when(k < 55, "established").when(k < 62, "rst")
        .when(k < 65, "fin").when(k < 75, "rejected").otherwise("new")
    )
    status = (
        F.when((u == 5) & (k < 70), "401").when(k < 80, "200").when(k < 90, "404").otherwise("500")
    )
    flow, http, dns, tls, ssh = [F.col("event_type") == t for t in EVENT_TYPES.values()]
    fwd = F.when(u == 6, 0).when(u == 9, F.col("cents") * 10_000).otherwise(F.col("cents"))
    bwd = F.when(u == 6, 0).otherwise(F.col("cents") * (k % 5))
    us = F.col("us")
    events = _base(spark, sf_dir).withColumn("event_type", et)
    return events.select(
        "event_type",
        (F.col("uid") * 10 + e % 4).cast("string").alias("flow_id"),
        F.concat(
            F.lit("10.0."), F.expr("uid div 256"), F.lit("."), F.col("uid") % 256
        ).alias("src_ip"),
        (40000 + e % 20000).cast("int").alias("src_port"),
        dst_ip.alias("dst_ip"),
        dst_port.alias("dst_port"),
        F.when(dst_port == 53, "UDP").otherwise("TCP").alias("proto"),
        F.when(flow, F.nullif(_pick(["", "http", "dns", "tls", "ssh"], k % 5), F.lit(""))).alias("app_proto"),
        F.timestamp_micros(us).alias("event_ts"),
        e.alias("seq"),
        F.when(flow, F.timestamp_micros(us - k * 10_000)).alias("start_ts"),
        F.when(flow, F.timestamp_micros(us)).alias("end_ts"),
        F.when(flow, F.when(u == 6, 0).otherwise(1 + k % 7)).cast("bigint").alias("fwd_pkts"),
        F.when(flow, F.when(u == 6, 0).otherwise(k % 5)).cast("bigint").alias("bwd_pkts"),
        F.when(flow, fwd).cast("bigint").alias("fwd_bytes"),
        F.when(flow, bwd).cast("bigint").alias("bwd_bytes"),
        F.when(flow, state).alias("state"),
        F.when(http, _pick(["GET", "POST", "PUT"], k % 3)).alias("http_method"),
        F.when(http, F.concat(F.lit("h"), k % 4)).alias("http_host"),
        F.when(http, F.concat(F.lit("/p/"), k % 9)).alias("http_uri"),
        F.lit(None).cast("string").alias("http_user_agent"),
        F.when(http, status).alias("http_status"),
        F.when(dns, F.concat(F.lit("q"), k % 6)).alias("dns_query"),
        F.when(dns, F.lit("A")).alias("dns_rrtype"),
        F.when(
            dns,
            F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(
                F.array(F.concat(F.lit("a"), k % 5), F.concat(F.lit("b"), k % 3))
            ),
        ).alias("dns_answers"),
        F.when(tls, F.concat(F.lit("s"), k % 5)).alias("tls_sni"),
        F.when(tls, _pick(["TLS 1.2", "TLS 1.3"], k % 2)).alias("tls_version"),
        F.lit(None).cast("string").alias("tls_subject"),
        F.lit(None).cast("string").alias("tls_issuer"),
        F.when(ssh, F.concat(F.lit("c"), k % 3)).alias("ssh_client"),
        F.lit(None).cast("string").alias("ssh_server"),
        (k == 99).alias("flagged"),
        k.alias("k"),
    )


def training_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled flow records in the layout of the public training files: stray
    blanks in headers, gaps (``k % 20 = 0``) and infinities (``k % 20 = 1``)."""
    k, cents = F.col("k"), F.col("cents")
    rate = (
        F.when(k % 20 == 0, F.lit(None)).when(k % 20 == 1, F.lit(float("inf")))
        .otherwise(cents / 10.0)
    )
    return _base(spark, sf_dir).select(
        F.col("e").alias("record_id"),
        _pick(PORTS, k % 10).cast("double").alias(" Destination Port"),
        (k * 1000 + F.col("e") % 1000).cast("double").alias(" Flow Duration"),
        (1 + k % 7).cast("double").alias(" Total Fwd Packets"),
        (k % 5).cast("double").alias(" Total Backward Packets"),
        cents.cast("double").alias("Total Length of Fwd Packets"),
        (cents * (k % 5)).cast("double").alias(" Total Length of Bwd Packets"),
        rate.cast("double").alias("Flow Bytes/s"),
        F.when(k % 20 == 2, F.lit(None)).otherwise((k + F.col("e") % 10) / 4.0).cast("double").alias(" Flow Packets/s"),
        (k % 5).cast("double").alias(" Down/Up Ratio"),
        F.when(F.col("event_type") == "error", "ATTACK").otherwise("BENIGN").alias(" Label"),
    )
