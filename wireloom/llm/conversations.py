"""Chat formatting by linking quotations.

Messages are parsed into their own text and nested levels of quoting. Lines and
paragraphs are normalised (white space, case) and hashed, quoted ones are joined
to the latest earlier message of the conversation that has them as its own, and
the message that most of the directly quoted text comes from is the one that is
replied to. Replies form trees, whose roots are found by doubling. A
conversation without quotes is its messages by tree and turn.

The join is an as-of join in pieces: inside ``CHUNK`` turns of one passage of
one conversation the latest earlier turn is found by a window, and what lies
before a piece comes from one row per piece. A passage or a conversation that
holds a third of all rows is many pieces, and no conversation is ever gathered:
its order is a sort key.

Null texts are empty messages. Null conversations or turns are kept and reply to
nothing, empty quotes link to nothing, ties go to the later message. Rows
repeated in conversation and turn count as one message when looked for and are
all returned. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted
from wireloom.sources.staging import materialize

CHUNK = 1024
QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
#: "On <date> <somebody> wrote:", the line that introduces a quote.
INTRODUCTION = re.compile(r"(?i)(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*")


def levels(text: str) -> list[tuple[int, str]]:
    """Each line with its level of quoting."""
    out = []
    for line in text.split("\n"):
        mark = QUOTE.match(line)
        out.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def normal(line: str) -> str:
    return " ".join(line.split()).casefold()


def parse(text: str) -> tuple[str, set[tuple[int, int]], set[tuple[int, int, int]]]:
    """The text without quotes; hash and length of its passages; level, hash and
    length of the quoted ones. A passage is a line, or a paragraph of several."""
    lines = levels(text)
    own, kept = set(), []
    quotes: set[tuple[int, int, int]] = set()
    block: list[str] = []

    def close(level: int) -> None:
        if len(block) > 1:
            add(level, " ".join(block))
        block.clear()

    def add(level: int, passage: str) -> None:
        key = xxhash.xxh3_64_intdigest(passage.encode("utf-8", "surrogatepass")) - (1 << 63)
        if level:
            quotes.add((level, key, len(passage)))
        else:
            own.add((key, len(passage)))

    before = 0
    for i, (level, line) in enumerate(lines):
        if level == 0:
            introduces = i + 1 < len(lines) and lines[i + 1][0] and INTRODUCTION.fullmatch(line.strip())
            if not introduces:
                kept.append(line)
        clean = normal(line)
        if level != before or not clean:
            close(before)
        before = level
        if clean:
            block.append(clean)
            add(level, clean)
    close(before)
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n") if quotes else text
    return body, own, quotes


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    passage = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("length", pa.int32())]))
    for batch in batches:
        bodies, passages = [], []
        for text in batch.column("text"):
            body, own, quotes = parse(text.as_py() or "")
            bodies.append(body if text.is_valid else None)
            passages.append([{"level": 0, "hash": h, "length": n} for h, n in sorted(own)] + [{"level": v, "hash": h, "length": n} for v, h, n in sorted(quotes)])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv", "turn", "role")], pa.array(bodies, pa.string()), pa.array(passages, passage)], ["conv", "turn", "role", "body", "passages"]
        )


def _sources(passages: DataFrame) -> DataFrame:
    """``conv, turn, level, length, source``: quoted passages and the latest
    earlier turn that has the passage as its own."""
    quotes = passages.filter("level > 0").distinct()
    wanted = materialize(quotes.select("conv", "hash").distinct(), "quotes-wanted")
    owned = passages.filter("level = 0").join(wanted, ["conv", "hash"], "left_semi").select("conv", "hash", "turn").distinct()
    none = F.lit(None)
    both = quotes.select("conv", "hash", "turn", "level", "length", none.cast("bigint").alias("own")).unionByName(
        owned.select("conv", "hash", "turn", none.cast("int").alias("level"), none.cast("int").alias("length"), F.col("turn").alias("own"))
    )
    both = materialize(both.withColumn("piece", F.floor(F.col("turn") / CHUNK)), "quotes-passages")
    inside = Window.partitionBy("conv", "hash", "piece").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv", "hash").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy("conv", "hash", "piece").agg(F.max("own").alias("last"))
    carry = materialize(carry.select("conv", "hash", "piece", F.max("last").over(before).alias("carried")), "quotes-carry")
    found = both.withColumn("here", F.max("own").over(inside)).filter("level is not null").join(carry, ["conv", "hash", "piece"])
    return found.select("conv", "turn", "level", "length", F.coalesce("here", "carried").alias("source")).filter("source is not null")


def _roots(links: DataFrame) -> DataFrame:
    """``conv, turn, reply_to, root, depth`` from ``conv, turn, reply_to``."""
    now = materialize(links.select("*", F.col("reply_to").alias("root"), F.lit(1).cast("bigint").alias("depth")), "quotes-roots")
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        joined = now.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        following = joined.select(
            "conv",
            "turn",
            "reply_to",
            F.coalesce("higher", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("higher").isNotNull().alias("moved"),
        )
        following = materialize(following, "quotes-roots")
        now = following.drop("moved")
        if following.filter("moved").isEmpty():
            return now


def link(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: ``conv, turn, role, body`` (without quotes),
    ``reply_to`` (a turn or null), ``root`` (the first turn of its thread) and
    ``depth``. Sorted by ``conv, root, turn`` it is the conversation."""
    own = messages.select(
        F.col(quoted(conversation)).alias("conv"), F.col(quoted(turn)).cast("bigint").alias("turn"), F.col(quoted(role)).cast("string").alias("role"), F.col(quoted(text)).alias("text")
    )
    kind = own.schema["conv"].dataType.simpleString()
    parsed = own.mapInArrow(
        _parsed, f"conv {kind}, turn bigint, role string, body string, passages array<struct<level:int,hash:bigint,length:int>>"
    )
    parsed = materialize(parsed, "quotes-messages")
    passages = parsed.filter("conv is not null and turn is not null").select("conv", "turn", F.inline("passages"))
    votes = _sources(passages).groupBy("conv", "turn", (F.col("level") == 1).alias("direct"), "source").agg(F.sum("length").alias("weight"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct("direct", "weight", "source")).alias("b"))
    links = _roots(best.select("conv", "turn", F.col("b.source").alias("reply_to")))
    joined = parsed.drop("passages").join(links, ["conv", "turn"], "left")
    return joined.select(
        "conv", "turn", "role", "body", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth")
    )


def formatted(linked: DataFrame) -> DataFrame:
    """Messages as lines of a chat, in reply order: a distributed sort."""
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("body", F.lit("")))
    return linked.withColumn("chat", chat).orderBy("conv", "root", "turn")


ship(__name__)
