"""Trusted sources and destinations.

``TrustedServices`` is configuration: it compiles to one predicate inside the
scan's stage, with no join. ``whitelist_rules`` gives the same content as a
table, and ``drop_whitelisted`` matches against any such table by equality of
network prefixes, so a rule list of any size needs neither a nested loop nor a
broadcast.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wireloom.functions.scalars import port_or_zero
from wireloom.sources.staging import materialize

# --- fixed values: addresses trusted by default ---
DNS_SERVERS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112",
    "208.67.222.222", "208.67.220.220", "64.6.64.6", "64.6.65.6",
)
UPDATE_SERVICES = (
    ("23.221.50.32", (80, 443)),
    ("104.16.0.0/12", (80, 443)),
    ("151.101.0.0/16", (80, 443)),
)
KNOWN_SERVICES = (("13.107.21.200", 443), ("13.107.42.12", 443))
MULTICAST = ("224.0.0.0/24", "239.255.255.250", "224.0.0.251", "255.255.255.255")
TRUSTED_INTERFACES = ("10.0.0.2",)
# --- end of fixed values ---

OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
DOTTED = rf"^{OCTET}(\.{OCTET}){{3}}$"
RULE_SCHEMA = "kind string, address string, prefix_len int, network string, port int, proto string"


def network_of(cidr: str) -> tuple[str, int]:
    """The address's digits, 8 or 32 hexadecimal ones, with the host part zero; bits of the prefix."""
    net = ipaddress.ip_network(cidr, strict=False)
    return net.network_address.packed.hex(), net.prefixlen


def hex_address(ip: Column) -> Column:
    """8 hexadecimal digits of a dotted address, 32 of an IPv6 one; null for other texts."""
    octets = F.split(ip, r"\.")
    dotted = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.try_cast("bigint"))), 2, "0")), "")
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = groups(F.split_part(ip, F.lit("::"), F.lit(1))), groups(F.split_part(ip, F.lit("::"), F.lit(2)))
    known = F.size(left) + F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - known))
    all_groups = F.concat(left, F.when(ip.contains("::"), zeros).otherwise(F.array().cast("array<string>")), right)
    colons = F.array_join(F.transform(all_groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    six = ip.contains(":") & (F.size(all_groups) == 8) & ~F.exists(all_groups, lambda g: ~g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return F.when(ip.rlike(DOTTED), dotted).when(six, colons)


def _network(digits: Column, bits: int, width: int) -> Column:
    """``digits`` with all but the first ``bits`` bits zero; null for addresses of another width."""
    whole, rest = divmod(bits, 4)
    parts = [F.substr(digits, F.lit(1), F.lit(whole))]
    if rest:
        digit = F.conv(F.substr(digits, F.lit(whole + 1), F.lit(1)), 16, 10).cast("int")
        size = 1 << (4 - rest)
        parts.append(F.lower(F.hex((digit - F.pmod(digit, F.lit(size))).cast("bigint"))))
    return F.when(F.length(digits) == width, F.rpad(F.concat(*parts), width, "0"))


def in_range(ip: Column, cidr: str) -> Column:
    """Range membership; equality where there is no prefix length.

    IPv4 is decided on the text: whole octets by prefix, a split octet by its
    range, so that almost every address is rejected by one string comparison.
    IPv6 is compared by its digits.
    """
    if "/" not in cidr:
        return ip == cidr
    if ":" in cidr:
        network, bits = network_of(cidr)
        return F.coalesce(_network(hex_address(ip), bits, 32) == network, F.lit(False))
    bits = int(cidr.split("/")[1])
    octets = cidr.split("/")[0].split(".")
    whole, rest = divmod(bits, 8)
    test = F.lit(True)
    if whole:
        head = ".".join(octets[:whole])
        test = ip.startswith(head + "." if whole < 4 else head)
    if rest:
        size = 1 << (8 - rest)
        low = int(octets[whole]) // size * size
        octet = F.split_part(ip, F.lit("."), F.lit(whole + 1)).try_cast("int")
        test = test & octet.between(low, low + size - 1)
    return F.coalesce(test & ip.rlike(DOTTED), F.lit(False))


@dataclass(frozen=True)
class TrustedServices:
    interfaces: tuple[str, ...] = TRUSTED_INTERFACES
    dns_servers: tuple[str, ...] = DNS_SERVERS
    ntp_servers: tuple[str, ...] = field(default=())
    known_services: tuple[tuple[str, int], ...] = KNOWN_SERVICES
    update_services: tuple[tuple[str, tuple[int, ...]], ...] = UPDATE_SERVICES
    multicast: tuple[str, ...] = MULTICAST

    def add_dns_server(self, ip: str) -> "TrustedServices":
        return self if ip in self.dns_servers else replace(self, dns_servers=(*self.dns_servers, ip))

    def add_known_service(self, ip: str, port: int) -> "TrustedServices":
        known = (ip, port) in self.known_services
        return self if known else replace(self, known_services=(*self.known_services, (ip, port)))

    def rows(self) -> list[tuple]:
        """Rule rows ``(kind, address, port or None, proto or None)``."""
        return [
            *[("interface", ip, None, None) for ip in self.interfaces],
            *[("dns", ip, 53, None) for ip in self.dns_servers],
            *[("ntp", ip, 123, proto) for ip in self.ntp_servers for proto in ("UDP", "TCP")],
            *[("service", ip, port, None) for ip, port in self.known_services],
            *[("update", ip, port, None) for ip, ports in self.update_services for port in ports],
            *[("multicast", ip, None, None) for ip in self.multicast],
        ]

    def match(self, ip: Column, port: Column, proto: Column) -> Column:
        """True where ``(ip, port, proto)`` is a trusted destination."""

        def any_of(tests: list[Column]) -> Column:
            return reduce(lambda a, b: a | b, tests, F.lit(False))

        anywhere = [*self.interfaces, *[a for a in self.multicast if "/" not in a]]
        exact = [
            *self.known_services,
            *[(a, p) for a, ports in self.update_services if "/" not in a for p in ports],
        ]
        ranges = [
            *[port.isin(list(ports)) & in_range(ip, a) for a, ports in self.update_services if "/" in a],
            *[in_range(ip, a) for a in self.multicast if "/" in a],
        ]
        tests = [
            ip.isin(anywhere),
            (port == 53) & ip.isin(list(self.dns_servers)),
            F.concat_ws(" ", ip, port).isin([f"{a} {p}" for a, p in exact]),
            *ranges,
        ]
        if self.ntp_servers:
            tests.append((port == 123) & proto.isin("UDP", "TCP") & ip.isin(list(self.ntp_servers)))
        return F.coalesce(any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def drop_trusted_sources(events: DataFrame, trusted: TrustedServices = TrustedServices()) -> DataFrame:
    if not trusted.interfaces:
        return events
    return events.filter(~F.coalesce(F.col("src_ip").isin(list(trusted.interfaces)), F.lit(False)))


def apply_whitelist(events: DataFrame, trusted: TrustedServices = TrustedServices()) -> DataFrame:
    """Drop events from trusted sources and events to trusted destinations.
    The destination test applies only to events with a port."""
    port = port_or_zero(F.col("dst_port"))
    hit = (port > 0) & trusted.match(F.col("dst_ip"), port, F.col("proto"))
    return drop_trusted_sources(events, trusted).filter(~hit)


def whitelist_rules(spark: SparkSession, trusted: TrustedServices = TrustedServices()) -> DataFrame:
    """The destination rules as a table, one row per address, port and protocol."""
    rows = []
    for kind, address, port, proto in trusted.rows():
        prefix, network = None, None
        if "/" in address:
            network, prefix = network_of(address)
        rows.append((kind, address, prefix, network, port, proto))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def extend_whitelist(rules: DataFrame, extra: DataFrame) -> DataFrame:
    return rules.unionByName(extra).distinct()


def drop_whitelisted(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``apply_whitelist``'s destination test against a rule table.

    The distinct destinations are matched (few against the events, and
    deduplicated map-side): by address, and by their network for each prefix
    length that occurs in the rules. The hits are stored and removed by an anti
    join on the destination, for which Spark picks the strategy from their size.
    """
    port = port_or_zero(F.col("dst_port"))
    target = ["dst_ip", "_port", "proto"]
    rows = events.withColumn("_port", port)
    targets = rows.filter("_port > 0 and dst_ip is not null").select(*target).distinct()
    exact = rules.filter("prefix_len is null").select("address", "port", F.col("proto").alias("_proto"))
    ranges = rules.filter("prefix_len is not null").select(
        "prefix_len", "network", "port", F.col("proto").alias("_proto")
    )
    fits = (F.col("port").isNull() | (F.col("port") == F.col("_port"))) & (
        F.col("_proto").isNull() | F.col("_proto").eqNullSafe(F.col("proto"))
    )
    by_address = targets.join(exact, targets.dst_ip == exact.address).filter(fits).select(*target)
    # at most 33 + 129 prefix lengths exist
    lengths = ranges.select("prefix_len", F.length("network").alias("w")).distinct().collect()
    networks = [
        F.struct(F.lit(r["prefix_len"]).alias("len"), _network(F.col("_digits"), r["prefix_len"], r["w"]).alias("net"))
        for r in lengths
    ]
    none = F.array().cast("array<struct<len:int,net:string>>")
    prefixes = targets.withColumn("_digits", hex_address(F.col("dst_ip"))).filter("_digits is not null")
    prefixes = prefixes.select(*target, F.explode(F.array(*networks) if networks else none).alias("_p"))
    by_range = (
        prefixes.join(
            ranges, (F.col("_p.len") == ranges.prefix_len) & (F.col("_p.net") == ranges.network)
        )
        .filter(fits)
        .select(*target)
    )
    hits = materialize(
        by_address.union(by_range).distinct().withColumnsRenamed({c: f"_h{c}" for c in target}), "hits"
    )
    same = (
        (F.col("dst_ip") == F.col("_hdst_ip"))
        & (F.col("_port") == F.col("_h_port"))
        & F.col("proto").eqNullSafe(F.col("_hproto"))
    )
    return rows.join(hits, same, "left_anti").drop("_port")
