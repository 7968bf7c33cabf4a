"""Quality rules by weak supervision.

Each rule looks at one statistic of a text and votes for good (1), for bad (-1)
or abstains (0). Nobody labels anything: expectation-maximisation over the
counts of vote patterns estimates how often documents are good and how often
each rule is right about good and about bad documents, and a document's
posterior probability of being good replaces the rule "all must pass".

Nulls and empty texts have no words. A text without words abstains on all but
the length, is ``base_failed`` and never kept. Ties and repeated rows are judged
alike, since the verdict depends on the text and the table's pattern counts
only. An empty table gives an empty result. Columns of the input that share a
name with an output column are replaced in the output of ``judge`` and
untouched by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wireloom.functions.shipping import ship
from wireloom.llm.text import WHITE, quoted, unused, words_of

STATS = "n_words n_distinct n_repeat_words word_chars n_symbols n_punct n_upper n_lines n_dup_lines".split()
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more; distinct words."""
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) < 4:
        return 0, len(codes)
    # two dense codings in a row keep the keys small whatever the vocabulary
    pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
    _, window, counts = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum()), len(codes)


def text_stats(text: str | None) -> tuple[int, ...]:
    words = words_of(text)
    if not words:
        return (0,) * 9
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    repeated, distinct = repeated_words(words)
    return (
        len(words),
        distinct,
        repeated,
        len(raw.translate(None, WHITE + CONTINUATION)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(raw) - len(raw.translate(None, PUNCT)),
        len(raw) - len(raw.translate(None, UPPER)),
        len(lines),
        len(lines) - len(set(lines)),
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in STATS]))
def _stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_stats(t) for t in batch], columns=STATS, dtype="int64")


def _vote(good: Column, bad: Column, votes: Column | None = None) -> Column:
    choice = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    return choice if votes is None else F.when(votes, choice).otherwise(F.lit(0))


def rule_votes(s: str) -> dict[str, Column]:
    """The rules over the statistics in the struct column ``s``."""
    n = lambda name: F.col(f"{s}.{name}").cast("double")
    words, some = n("n_words"), F.col(f"{s}.n_words") > 0
    per_word = lambda name: n(name) / words
    mean = n("word_chars") / words
    duplicate = n("n_dup_lines") / n("n_lines")
    repeated = per_word("n_repeat_words")
    distinct = per_word("n_distinct")
    symbols = per_word("n_symbols")
    punct = n("n_punct") / n("word_chars")
    upper = n("n_upper") / n("word_chars")
    return {
        "length": _vote(words >= 100, words < MIN_WORDS),
        "symbols": _vote(symbols <= 0.05, symbols > 0.2, some),
        "duplicate_lines": _vote(duplicate <= 0.2, duplicate > 0.35, F.col(f"{s}.n_lines") >= 3),
        "repeated_words": _vote(repeated <= 0.15, repeated > 0.4, words >= 20),
        # long texts use up their vocabulary, whoever wrote them
        "distinct_words": _vote(distinct >= 0.6, distinct < 0.4, words.between(20, 1000)),
        "punctuation": _vote(punct <= 0.08, punct > 0.12, some),
        "upper_case": _vote(upper <= 0.12, upper > 0.3, some),
        "word_length": _vote(mean.between(3.5, 7.0), (mean < 2.5) | (mean > 7.4), some),
    }


def fit_label_model(
    patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200
) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over pattern counts.

    Returns the share of good documents and, per rule, the probability that a
    vote cast on a good (on a bad) document is right. Each rate starts from, and
    is drawn with the weight of ten votes to, a prior under which rules are
    better than chance, so the classes can't swap.
    """
    share, right = 0.8, [(0.9, 0.6)] * rules
    if not patterns:
        return share, right
    votes = np.array([p for p, _ in sorted(patterns)], dtype=np.int64)
    count = np.array([n for _, n in sorted(patterns)], dtype=float)
    up, down = votes == 1, votes == -1
    a, b = np.full(rules, 0.9), np.full(rules, 0.6)
    for _ in range(rounds):
        good = np.log(share) + up @ np.log(a) + down @ np.log1p(-a)
        bad = np.log1p(-share) + up @ np.log1p(-b) + down @ np.log(b)
        p = 1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500)))
        w, v = p * count, (1 - p) * count
        new_share = (w.sum() + 8) / (count.sum() + 10)
        new_a = (w @ up + 9) / (w @ (up | down) + 10)
        new_b = (v @ down + 6) / (v @ (up | down) + 10)
        moved = max(abs(new_share - share), np.abs(new_a - a).max(), np.abs(new_b - b).max())
        share, a, b = new_share, new_a, new_b
        if moved < 1e-10:
            break
    return float(share), [(float(x), float(y)) for x, y in zip(a, b)]


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and the struct ``quality`` with the statistics,
    ``votes``, ``posterior``, ``base_failed`` and ``kept``.

    Two passes over the texts: one counts vote patterns (at most 3 to the number
    of rules reach the driver, however many rows there are), one judges.
    """
    s, v = unused(docs, "_stats"), unused(docs, "_votes")
    stats = docs.withColumn(s, _stats(F.col(quoted(text))))
    votes = rule_votes(s)
    counted = stats.select(F.array(*votes.values()).alias("v")).groupBy("v").count().collect()
    share, right = fit_label_model([(tuple(r["v"]), r["count"]) for r in counted], len(votes))
    evidence = F.lit(math.log(share / (1 - share)))
    for i, (a, b) in enumerate(right):
        cast = F.col(v)[i]
        evidence = evidence + F.when(cast == 1, F.lit(math.log(a / (1 - b)))).when(
            cast == -1, F.lit(math.log((1 - a) / b))
        ).otherwise(F.lit(0.0))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-evidence))
    words = F.col(f"{s}.n_words")
    failed = (words < MIN_WORDS) | (F.col(f"{s}.n_repeat_words") * 100 > words * 50)
    named = F.create_map(*[x for i, n in enumerate(votes) for x in (F.lit(n), F.col(v)[i])])
    quality = F.struct(
        f"{s}.*",
        named.alias("votes"),
        posterior.alias("posterior"),
        failed.alias("base_failed"),
        (~failed & (posterior >= threshold)).alias("kept"),
    )
    return stats.withColumn(v, F.array(*votes.values())).withColumn("quality", quality).drop(s, v)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose quality is good enough, with their own columns."""
    q = unused(docs, "_quality")
    renamed = docs.withColumnRenamed("quality", q) if "quality" in docs.columns else docs
    good = judge(renamed, text, threshold).filter("quality.kept").drop("quality")
    return good.withColumnRenamed(q, "quality") if "quality" in docs.columns else good


ship(__name__)
