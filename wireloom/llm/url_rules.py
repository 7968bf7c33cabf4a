"""URL rules as a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot, so a rule's
host and all its subdomains are one interval of keys. Pages and rules are dealt
into ranges of keys, a rule into every range that its interval meets, and sorted
by key; one sweep over a range keeps a stack of the rules whose intervals hold
the current key, outermost first, and looks the path up among theirs. The
longest fitting rule wins.

A page's key ends with a hash of the row, so a host with very many pages is
spread over as many ranges as its size asks for. The borders come from a bounded
sample of keys and only decide the balance.

Null urls and those without ``://`` have an empty host and path and fit no rule.
Urls of any length are judged whole. Repeated rows are judged alike. Of two
rules with the same text, one that blocks wins. An empty table gives an empty
result; without rules every page gets the default verdict. Further columns of
the pages are ignored.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted

SAMPLE_KEYS = 20_000
RANGE_ROWS = 200_000
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _borders(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys of a sample of at most about ``SAMPLE_KEYS``."""
    share = min(1.0, SAMPLE_KEYS / max(rows, 1))
    picked = keys.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    sample = sorted(r["key"] for r in picked.select("key").limit(2 * SAMPLE_KEYS).collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


class Sweep:
    """The active rules at the current key, and the best one for a path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, prefix: str, path: str, rule: str, verdict: str) -> None:
        self.move(prefix)
        if not self.stack or self.stack[-1][0] != prefix:
            self.stack.append((prefix, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or verdict == "block":
            paths[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def best(self, path: str) -> tuple[str | None, str | None]:
        found: tuple[str | None, str | None] = (None, None)
        for _, paths, lengths in self.stack:
            for n in lengths:
                here = paths.get(path[:n]) if n <= len(path) else None
                if here is not None:
                    if found[0] is None or len(here[0]) >= len(found[0]):
                        found = here
                    break
        return found


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sweep, part = Sweep(), None
    for batch in batches:
        keep, rules, verdicts = [], [], []
        rows = zip(batch["part"], batch["key"], batch["is_page"], batch["path"], batch["rule"], batch["verdict"])
        for i, (p, key, is_page, path, rule, verdict) in enumerate(rows):
            if p != part:
                sweep, part = Sweep(), p
            if not is_page:
                sweep.open(key, path, rule, verdict)
                continue
            sweep.move(key)
            keep.append(i)
            rule, verdict = sweep.best(path)
            rules.append(rule)
            verdicts.append(verdict)
        out = batch.iloc[keep][["id", "host", "path"]].copy()
        out["rule"], out["verdict"] = pd.Series(rules, out.index, dtype=object), pd.Series(verdicts, out.index, dtype=object)
        yield out


def judge(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """``id, host, path, rule, verdict`` of every page. ``rules`` has the columns
    ``rule`` (host, then path from the first slash on) and ``verdict``."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(quoted(url)))
    parted = pages.select(F.col(quoted(key)).alias("id"), host.alias("host"), path.alias("path"), F.col(quoted(url)).alias("url"))
    mark = F.lpad(F.hex(F.xxhash64("id", "url")), 16, "0")
    keyed = parted.withColumn("key", F.concat(host_key(F.col("host")), F.lit("\x01"), mark)).drop("url")
    n = pages.count()
    ranges = min(SAMPLE_KEYS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    borders = _borders(keyed, n, ranges)

    @F.pandas_udf(T.LongType())
    def part_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(borders, k)).astype("int64")

    slash = F.instr("rule", "/")
    lower = host_key(F.translate(F.when(slash > 0, F.substr("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")), string.ascii_uppercase, string.ascii_lowercase))
    opened = rules.select(
        lower.alias("key"), F.when(slash > 0, F.substr("rule", slash, F.length("rule"))).otherwise(F.lit("")).alias("path"), "rule", "verdict"
    )
    # the key after the last one of the interval: a slash follows the dot and is in no host
    beyond = F.concat(F.substr("key", F.lit(1), F.length("key") - 1), F.lit("/"))
    spread = opened.withColumn("part", F.explode(F.sequence(part_of("key"), part_of(beyond))))
    none = F.lit(None)
    both = keyed.select(
        part_of("key").alias("part"), "key", F.lit(True).alias("is_page"), "id", "host", "path", none.cast("string").alias("rule"), none.cast("string").alias("verdict")
    ).unionByName(
        spread.select(
            F.col("part").cast("bigint").alias("part"),
            "key",
            F.lit(False).alias("is_page"),
            none.cast(parted.schema["id"].dataType).alias("id"),
            none.cast("string").alias("host"),
            "path",
            "rule",
            "verdict",
        )
    )
    dealt = both.repartitionByRange(ranges, "part").sortWithinPartitions("part", "key", "is_page")
    kind = parted.schema["id"].dataType.simpleString()
    swept = dealt.mapInPandas(_swept, f"id {kind}, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


ship(__name__)
