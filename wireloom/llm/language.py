"""Language identification by fusing evidence about web pages.

Four kinds of evidence are combined by Bayes' rule: the likelihood of the text
under a model of byte trigrams per language, the language that the markup
declares, the language segment of the address, and a prior of the host. How far
declarations can be trusted is learned from how they agree with the texts. Host
priors are counts of what the texts on a host say, without the page itself,
smoothed towards the domain's, its suffix's and finally all pages' shares, each
computed by a grouped aggregation.

The trigram models are counts over all documents with a language. Pages without
text, declaration or address are judged by the remaining evidence. Nulls are
missing evidence, an empty page is a page without text. Long pages are read
whole. Repeated rows count as rows. Of languages with equal probability the
first in order wins. Without labelled documents the language is null.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted
from wireloom.llm.url_rules import host_and_path
from wireloom.sources.staging import materialize

BUCKETS = 1 << 14
#: Languages at most, those with the most documents.
MAX_LANGUAGES = 256
#: Overlapping trigrams repeat each other's evidence.
TEMPER = 0.2
#: Pages that a level of the host hierarchy needs to weigh as much as the level above.
STRENGTH = 20.0

DECLARED = re.compile(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    mixed = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return mixed >> np.uint32(18)


def visible(page: str) -> str:
    """The text between the tags, without scripts, styles and comments."""
    out, skip = [], ""
    for i, piece in enumerate(page.split("<")):
        if i == 0:
            out.append(piece)
            continue
        if skip == "-->":
            if "-->" in piece:
                out.append(piece.rpartition("-->")[2])
                skip = ""
            continue
        low = piece[:10].lower()
        if skip and not low.startswith(skip):
            continue
        skip = ""
        if low.startswith("!--"):
            if "-->" in piece:
                out.append(piece.rpartition("-->")[2])
            else:
                skip = "-->"
            continue
        if low.startswith(("script", "style")):
            skip = "/script" if low.startswith("script") else "/style"
            continue
        out.append(" " + piece.partition(">")[2])
    return markup.unescape("".join(out))


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # languages x buckets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            ids = trigrams(text.as_py().encode())
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
            if len(ids) > BUCKETS // 8:
                sums[lang] += np.bincount(ids, minlength=BUCKETS)
            else:
                np.add.at(sums[lang], ids, 1)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts of all labelled documents, summed on the executors."""
    own = docs.select(F.col(quoted(lang)).alias("lang"), F.col(quoted(text)).alias("text")).filter("lang is not null and text is not null")
    top = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    languages = sorted(r["lang"] for r in top.collect())
    counted = own.filter(F.col("lang").isin(languages)).mapInArrow(_count, "lang string, bucket int, n bigint")
    counts = np.ones((len(languages), BUCKETS)) * 0.5
    place = {x: i for i, x in enumerate(languages)}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[place[r["lang"]], r["bucket"]] += r["n"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts
    return Model(languages, logs.astype(np.float32))


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(model.languages)
        for batch in batches:
            declared, segment, logs = [], [], []
            for page, path in zip(batch.column("html"), batch.column("path").to_pylist()):
                page = page.as_py() or ""
                found = DECLARED.search(page)
                said = found[1].lower() if found else None
                declared.append(said if said in known else None if said is None else "other")
                first = path[1:].partition("/")[0].lower() if path else ""
                segment.append(first if first in known else None)
                ids = trigrams(visible(page).encode("utf-8", "surrogatepass"))
                scores = TEMPER * model.logs[:, ids].sum(axis=1, dtype=np.float64)
                logs.append(scores - scores.max(initial=-np.inf) if len(scores) else scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), pa.array(declared, pa.string()), pa.array(segment, pa.string()), pa.array(logs, pa.list_(pa.float64()))],
                ["id", "host", "declared", "segment", "logs"],
            )

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _plus(a: Column, b: Column, sign: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.lit(sign) * y)


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares of ``counts``, drawn towards those of the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def identify(
    pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``id, host, declared, segment, text_lang, lang, posterior`` of every page."""
    n = len(model.languages)
    host, path = host_and_path(F.col(quoted(url)))
    own = pages.select(F.col(quoted(key)).alias("id"), F.col(quoted(html)).alias("html"), host.alias("host"), path.alias("path"))
    kind = own.schema["id"].dataType.simpleString()
    seen = own.mapInArrow(_evidence(model), f"id {kind}, host string, declared string, segment string, logs array<double>")
    if not n:
        none = F.lit(None).cast("string")
        return seen.select("id", "host", "declared", "segment", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    seen = materialize(seen.withColumn("p", _softmax(F.col("logs"))), "language-evidence")

    def sums(rows: DataFrame, *by: str) -> DataFrame:
        added = rows.groupBy(*by).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])
        return added.select(*by, F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(n)]).alias("p"))

    # declarations and segments: at most one row per language and two more
    def trust(column: str) -> Column:
        rows = sums(seen.withColumn(column, F.coalesce(column, F.lit("none"))), column).collect()
        total = np.sum([r["p"] for r in rows], axis=0) if rows else np.zeros(n)
        table = {r[column]: [math.log((c + 1) / (t + len(rows) + 1)) for c, t in zip(r["p"], total)] for r in rows}
        chosen = F.lit(None).cast("array<double>")
        for value, logs in table.items():
            at = F.coalesce(F.col(column), F.lit("none")) == value
            chosen = F.when(at, F.array(*[F.lit(x) for x in logs])).otherwise(chosen)
        return chosen

    overall = sums(seen.withColumn("all", F.lit(1)), "all").first()
    everything = F.array(*[F.lit(float(x)) for x in overall["p"]]) if overall else F.array(*[F.lit(0.0)] * n)
    labels = F.split("host", r"\.")
    hosts = sums(seen, "host").withColumns({"domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), "suffix": F.element_at(labels, -1)})
    hosts = materialize(hosts, "language-hosts")
    domains = sums(hosts, "domain").withColumnRenamed("p", "domain_p")
    suffixes = sums(hosts, "suffix").withColumnRenamed("p", "suffix_p")
    hosts = hosts.withColumnRenamed("p", "host_p").join(domains, "domain").join(suffixes, "suffix")
    hosts = materialize(hosts.select("host", "host_p", "domain_p", "suffix_p"), "language-priors")
    rows = seen.withColumns({"d": trust("declared"), "g": trust("segment")}).join(hosts, "host")
    # what the page itself added is taken away at each level
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    prior = _smoothed(_plus(everything, F.col("p"), -1.0), uniform)
    for level in ("suffix_p", "domain_p", "host_p"):
        rows = rows.withColumn("prior", prior)
        prior = _smoothed(_plus(F.col(level), F.col("p"), -1.0), F.col("prior"))
    rows = rows.withColumn("prior", prior)
    fused = _plus(_plus(_plus(F.col("logs"), F.col("d")), F.col("g")), F.transform("prior", lambda x: F.log(F.greatest(x, F.lit(1e-12)))))
    judged = rows.withColumn("post", _softmax(fused))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return judged.select(
        "id", "host", "declared", "segment", best(F.col("logs")).alias("text_lang"), best(F.col("post")).alias("lang"), F.array_max("post").alias("posterior")
    )


ship(__name__)
