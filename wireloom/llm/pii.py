"""Personal data: validated patterns, and a boosted model for what they miss.

Fixed patterns with checks (octets, Luhn, digit counts) give the base spans.
High-recall generators then propose further, overlapping candidates: digit
groups with any separators, spelled-out addresses. Boosted trees judge each
candidate by its format and the words around it, their margin is calibrated to a
probability, a threshold per kind selects, and of overlapping selected ones the
most probable stays. Base spans are never dropped.

The model is weakly supervised. Positive examples are the base spans of all
documents: as they are, disguised in place (``+`` left out,
separators exchanged, ``@`` and dots spelled out), and run into a number before
or behind them, so that the fixed pattern loses them. Negative ones are wrong
cuts of these, near misses made of them (check digit off by one, octet over
255), and the other candidates of the same documents. A candidate that would be
a base span if it stood alone is neither. Where the documents hold no example of
one of the classes, nothing is added to the base spans.

Calibration and thresholds come from all documents: every one is scored
by trees that were fitted without it. Only candidates that meet no base span
count, and of overlapping ones the best alone, as in use.

Null and empty texts have no spans. Repeated rows and ties get equal results. An
empty table gives an empty result. Every text is searched whole, each pattern in
time linear in the text. Columns called ``pii`` are replaced by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from math import ceil, exp
from typing import NamedTuple
from zlib import crc32

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted, unused
from wireloom.sources.staging import materialize

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.97
TREES, DEPTH = 16, 4
FOLDS = 2
#: Candidates of its own that a kind needs above its threshold.
OWN = 5
STEPS = 1000
#: Examples that a task hands over at once.
HANDED = 5_000

LABEL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
LOCAL = frozenset(LABEL + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before would have been the start: it makes the search linear and changes no match
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

GROUPS = re.compile(r"[0-9]+(?:[\x20().,:/-]{1,3}[0-9]+)*")
# what follows the sign, with and without spaces around literal dots
HOSTS = tuple(
    re.compile(rf"(?i)\x20?[a-z0-9-]+(?:(?:\x20?[\[({{]\x20?dot\x20?[\])}}]\x20?|\x20{{1,2}}dot\x20{{1,2}}|{dot})[a-z0-9-]+)+")
    for dot in (r"\x20?\.\x20?", r"\.")
)
AT = re.compile(r"(?i)[\[({]\x20?at\x20?[\])}]|\x20at\x20|@")
DOT = re.compile(r"(?i)[\[({]\x20?dot\x20?[\])}]|\x20dot\x20")
#: Ways to spell the sign and the host's dots.
SIGNS = (
    (" at ", " dot "),
    (" [at] ", " [dot] "),
    ("[at]", "[dot]"),
    (" (at) ", "."),
    (" [at] ", "."),
    (" @ ", "."),
    (" at ", "."),
)
CUES = (
    ("mail", "write", "courriel"),
    ("ip", "host", "server", "addr"),
    ("card", "visa", "pay", "carte", "karte"),
    ("phone", "tel", "call", "fax", "mobil"),
)

Span = tuple[str, int, int]


class Cover:
    """Which stretches of a text are taken."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping within each kind."""
    out: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all kinds."""
    out: list[Span] = []
    for m in AT.finditer(text):
        begin = edge = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        while begin and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < edge:
            ends = {found.end() for host in HOSTS if (found := host.match(text, m.end()))}
            out += [("email", begin, end) for end in sorted(ends)]
    for m in GROUPS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts = [(g.start(), g.end()) for g in DIGITS.finditer(text, m.start(), m.end())]
        for i in range(len(parts)):
            total = 0
            for j in range(i, len(parts)):
                total += parts[j][1] - parts[j][0]
                if total > 19:
                    break
                start, end = parts[i][0], parts[j][1]
                if start and text[start - 1] in "(+":
                    start -= 1 + (start > 1 and text[start - 2] == "+")
                if total >= 13:
                    out.append(("card", start, end))
                if 7 <= total <= 15:
                    out.append(("phone", start, end))
                if j - i == 3 and all(b - a <= 3 for a, b in parts[i : j + 1]):
                    out.append(("ip", start, end))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, each a small number."""
    kind, start, end = span
    body = text[start:end]
    groups = [len(g) for g in DIGITS.findall(body)]
    digits = "".join(DIGITS.findall(body))
    before = text[max(0, start - 48) : start].lower()
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    out = [float(kind == k) for k in KINDS]
    out += [float(any(c in before for c in cues)) for cues in CUES]
    out += [float(body.count(c)) for c in " -.(/,:"]
    out += [
        float(len(body)),
        float(len(digits)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(body.startswith("+")),
        float(luhn(digits) if len(digits) >= 13 else False),
        float(all(int(g) <= 255 for g in DIGITS.findall(body) if len(g) < 9)),
        float("@" in body),
        float(len(AT.findall(body))),
        float(len(DOT.findall(body))),
        float(left.isalnum()),
        float(right.isalnum()),
        float(bool(DIGITS.search(text, max(0, start - 3), start))),
        float(bool(DIGITS.search(text, end, end + 3))),
        float(left in "+-./:,#$"),
        float(right in "-/:%"),
        float(any(c in body for c in "[({")),
        float(". " in body),
        float(len(body) - len(body.rstrip(LABEL))),
    ]
    return out


def disguise(body: str, kind: str) -> str:
    """The same data as somebody might write it to escape a pattern."""
    if kind == "email":
        sign, dot = SIGNS[crc32(body.encode()) % len(SIGNS)]
        local, _, host = body.partition("@")
        return local + sign + host.replace(".", dot)
    if kind == "phone":
        return body.lstrip("+")
    return body.replace("-", " ").replace(".", " . " if kind == "ip" else ".").replace(" ", "." if kind == "card" else " ")


def with_digits(body: str, digits: str) -> str:
    """``body`` with its digits replaced in order."""
    following = iter(digits)
    return "".join(next(following) if c in "0123456789" else c for c in body)


def checked(digits: str, off: int = 0) -> str:
    """The digits with a last one that makes the Luhn sum right, or misses it by ``off``."""
    right = next(d for d in range(10) if luhn(digits[:-1] + str(d)))
    return digits[:-1] + str((right + off) % 10)


def variants(body: str, kind: str) -> list[tuple[str, str, str, bool]]:
    """``(before, hidden, after, right)``: the data in forms that the fixed patterns
    lose, and near misses of it that are no data."""
    coin = crc32(body.encode())
    out = [("", disguise(body, kind), "", True)]
    if kind == "phone":
        out.append(("", body, " " + ".".join(str(b) for b in coin.to_bytes(4, "big")), True))
        out.append(("", body, f" {coin:010d}", True))
    if kind == "card":
        digits = "".join(DIGITS.findall(body))
        other = with_digits(body, checked("".join(str((int(d) * 7 + 3) % 10) for d in digits)))
        out += [("", body, " " + other, True), (other + " ", body, "", True)]
        wrong = with_digits(body, checked(digits, 1 + coin % 9))
        out += [("", wrong, "", False), ("", wrong, " " + other, False), ("", disguise(wrong, kind), "", False)]
    if kind == "ip":
        octets = body.split(".")
        octets[coin % 4] = str(256 + coin % 700)
        wrong = ".".join(octets)
        out += [("", wrong, "", False), ("", disguise(wrong, kind), "", False), ("", wrong, f".{coin % 99}", False)]
    return out


def alone(text: str, span: Span) -> bool:
    """Whether the span would be a base span without its surroundings."""
    kind, a, b = span
    return (kind, 0, b - a) in base_spans(text[a:b])


def examples(text: str) -> list[tuple[str, list[float], float, bool, int, int]]:
    """``(kind, features, label, apart, group, length)`` of base spans, their variants
    and the rest; ``apart`` where no base span is met, as in all that is scored
    later; of a group at most one is selected later."""
    base = base_spans(text)
    taken = Cover(base)
    out, group = [], 0
    for kind, a, b in base:
        out.append((kind, features(text, (kind, a, b)), 1.0, False, group, b - a))
        for before, hidden, after, right in variants(text[a:b], kind):
            group += 1
            near = text[max(0, a - 64) : a] + before
            shown, begin, end = near + hidden + after + text[b : b + 8], len(near), len(near) + len(hidden)
            around = Cover(base_spans(shown))
            for span in {(kind, begin, end), *candidates(shown)}:
                if span[1] < end and begin < span[2]:
                    label = float(right and span == (kind, begin, end))
                    out.append((span[0], features(shown, span), label, not around.meets(span[1], span[2]), group, span[2] - span[1]))
    edge = 0
    for span in sorted(candidates(text), key=lambda s: s[1]):
        if span[1] >= edge:
            group, edge = group + 1, span[1] + 32
        if not taken.meets(span[1], span[2]) and not alone(text, span):
            out.append((span[0], features(text, span), 0.0, True, group, span[2] - span[1]))
    return out


class Model(NamedTuple):
    """Trees as nested tuples ``(feature, threshold, left, right)`` or leaves, slope and
    intercept of the calibration, and thresholds by kind with the right and all
    held-out candidates above them."""

    trees: list
    weights: list[float]
    scale: tuple[float, float]
    thresholds: dict[str, float]
    held_out: dict[str, tuple[int, int]]

    def margin(self, x: list[float]) -> float:
        total = 0.0
        for tree, w in zip(self.trees, self.weights):
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            total += w * tree
        return total

    def probability(self, x: list[float]) -> float:
        slope, intercept = self.scale
        return 1.0 / (1.0 + exp(-max(-700.0, min(700.0, slope * self.margin(x) + intercept))))


NOTHING = Model([], [], (0.0, 0.0), {}, {})


def _exported(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _exported(node.leftChild()), _exported(node.rightChild()))


def rising(steps: dict[int, tuple[float, int]]) -> list[tuple[int, int, float, int]]:
    """Isotonic regression: ``(lowest step, highest step, right ones, all)`` of runs of
    steps whose share of right ones rises from run to run."""
    out: list[tuple[int, int, float, int]] = []
    for step in sorted(steps):
        low, high, good, n = step, step, *steps[step]
        while out and out[-1][2] * n >= good * out[-1][3]:
            low, good, n = out[-1][0], good + out[-1][2], n + out[-1][3]
            out.pop()
        out.append((low, high, good, n))
    return out


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> Model:
    """Trees on the examples of all documents; calibration and thresholds on the out-of-fold
    scores of those that meet no base span.

    A kind's threshold lies half way below the first run of its isotonic shares in which its own
    candidates, and those of all kinds with one wrong one added, are right at the
    asked rate; it is never below that rate itself.
    """
    body = docs.select(F.col(quoted(text)).alias("text")).filter(F.col("text").isNotNull())
    body = body.withColumn("place", F.xxhash64("text", F.lit(11)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "x", "label", "apart", "group", "size", "place"]
        for batch in batches:
            rows = []
            for t, p in zip(batch["text"], batch["place"]):
                rows += [(*x, p) for x in examples(t)]
                if len(rows) >= HANDED:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    schema = "kind string, x array<double>, label double, apart boolean, group bigint, size bigint, place bigint"
    drawn = materialize(body.mapInPandas(draw, schema), "pii-examples").withColumn("features", array_to_vector("x")).drop("x")
    fold = F.pmod("place", F.lit(1_000_003)) % FOLDS
    classes = {(r["fold"], r["label"]) for r in drawn.select(fold.alias("fold"), "label").distinct().collect()}
    if any(len({c for f, c in classes if f != i}) < 2 for i in range(FOLDS)):
        return NOTHING
    trainer = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=64)
    parts = [drawn.filter(fold != i) for i in range(FOLDS)] + [drawn]
    with ThreadPoolExecutor(len(parts)) as pool:
        *folds, model = pool.map(trainer.fit, parts)

    margin = vector_to_array("rawPrediction")[1]
    held = [m.transform(drawn.filter((fold == i) & F.col("apart"))).select("kind", "label", "group", "place", "size", margin.alias("margin")) for i, m in enumerate(folds)]
    best = held[0]
    for part in held[1:]:
        best = best.unionByName(part)
    row = F.struct("kind", "label", "margin")
    best = best.groupBy("place", "group").agg(F.max_by(row, F.struct("margin", -F.col("size"), "label")).alias("top")).select("top.*")
    best = materialize(best, "pii-held-out")
    if best.select("label").distinct().count() < 2:
        return NOTHING
    vector = best.withColumn("features", array_to_vector(F.array("margin")))
    line = LogisticRegression(regParam=1e-4, standardization=False).fit(vector)
    scale = (float(line.coefficients[0]), float(line.intercept))
    p = 1.0 / (1.0 + F.exp(-(F.col("margin") * scale[0] + scale[1])))
    counted = best.groupBy("kind", F.floor(p * STEPS).alias("step")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()

    thresholds, held_out = {}, {}
    for kind in KINDS:
        steps = {r["step"]: (r["good"], r["n"]) for r in counted if r["kind"] == kind}
        before = None
        for low, high, good, n in rising(steps):
            # half way down to the run before, as between two knots
            low, before = low if before is None else (before + low + 1) // 2, high
            similar = [r for r in counted if low <= r["step"] <= high]
            pooled, of = sum(r["good"] for r in similar), sum(r["n"] for r in similar)
            if n >= OWN and good >= precision * n and pooled >= precision * (of + 1):
                # no candidate below the asked rate by its own probability, however sure the ones above
                step = max(low, ceil(precision * STEPS))
                above = [r for r in counted if r["kind"] == kind and r["step"] >= step]
                if above:
                    thresholds[kind] = step / STEPS
                    held_out[kind] = int(sum(r["good"] for r in above)), int(sum(r["n"] for r in above))
                break
    trees = [_exported(t._java_obj.rootNode()) for t in model.trees]
    return Model(trees, list(model.treeWeights), scale, thresholds, held_out)


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans; by kind, then start."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = base_spans(text)
    chosen = []
    taken = Cover(base)
    if model.thresholds:
        for span in candidates(text):
            if span[0] in model.thresholds and not taken.meets(span[1], span[2]):
                p = model.probability(features(text, span))
                if p >= model.thresholds[span[0]]:
                    chosen.append((-p, span[1] - span[2], span))
    added: list[Span] = []
    for _, _, span in sorted(chosen):
        if not taken.meets(span[1], span[2]):
            taken.add(span[1], span[2])
            added.append(span)
    rank = lambda s: (order[s[0]], s[1])
    return sorted(base, key=rank), sorted(base + added, key=rank)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans the one that starts first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "redacted")]
)


def _finder(model: Model):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                base, spans = all_spans(t or "", model)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(spans), t if t is None else redacted(t, spans)))
            yield pd.DataFrame(rows, columns=FOUND.names)

    return F.pandas_udf(run, FOUND)


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` and the struct ``pii``: counts and digest of the
    base spans, all spans, and the text without them."""
    model = fit(docs, text) if model is None else model
    return docs.withColumn("pii", _finder(model)(F.col(quoted(text))))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``length``, where
    there is such a column, set to the new length. Other columns stay as they are."""
    model = fit(docs, text) if model is None else model
    p = unused(docs, "_pii")
    out = docs.withColumn(p, _finder(model)(F.col(quoted(text))))
    clean = F.col(f"{p}.redacted")
    kinds = dict(docs.dtypes)
    columns = {text: clean}
    if length in kinds:
        columns[length] = F.when(F.col(quoted(text)).isNull(), F.col(quoted(length))).otherwise(F.length(clean).cast(kinds[length]))
    return out.select(*[columns.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


ship(__name__)
