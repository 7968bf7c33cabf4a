"""SentencePiece encoding and decoding with a relational lattice.

The distinct words of the corpus, not its texts, are segmented. All substrings
of a word from two characters up to the longest piece are exploded and joined to
the piece table; the matches, and the pieces of single characters, are the edges of the word's lattice; they are grouped with the words
of a bucket, and Viterbi's recurrence runs over the positions of all its words
at once. The result is the segmentation with the highest sum of scores; of equal
sums the one whose last differing piece is longer.

A word here is a run of spaces with the characters after it that occur in
pieces of several characters, up to a sign that follows a letter or digit in no
piece, like most commas; every other character stands alone. No piece crosses
such a border (the table is refused if one does), so words can be segmented one
by one. Characters without a piece become byte pieces.

Documents are dealt into blocks of bounded size by a hash. Each block asks for
its distinct words once, in packed lists dealt by a hash of the word, gets lists
of ids back, and is put together from them. A text is moved once, compressed.

A null text has null ids, an empty one none. Texts of any length are encoded
whole; words longer than ``LONG`` characters go through the same recurrence
outside the join. Repeated rows get equal ids. An empty table gives an empty
result. The id column replaces an input column of the same name. A literal
U+2581, the sign that stands for a space inside pieces, is encoded by bytes, so
that every text is decoded to itself.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Pieces in a table at most; the table is broadcast.
MAX_PIECES = 1_000_000
BLOCK_CHARS = 8_000_000
#: Characters of text for each part into which the distinct words are dealt.
WORD_CHARS = 2_000_000
LONG = 1024
#: Characters at which a piece can't begin unless one does, so that fewer substrings are joined.
OPENING = 4
#: Words times positions that the recurrence holds at a time.
CELLS = 1_000_000
UNKNOWN_PENALTY = 10.0
#: Ids that are decoded at a time.
DECODED_IDS = 250_000


class Pieces(NamedTuple):
    rows: list[tuple[str, int, float]]  # piece with plain spaces, id, score
    bytes_ids: list[int]  # id of the piece of each byte value
    unknown: float  # score of a character without a piece
    longest: int
    inner: str  # characters that occur in pieces of several characters
    breaks: str  # those of them, no letters or digits, that follow one in no piece

    def pattern(self) -> str:
        """Finds the words of a text, one after the other."""
        some = lambda chars: "".join(re.escape(c) for c in chars)
        plain = some(c for c in self.inner if c.isalnum())
        joins = some(c for c in self.inner if not c.isalnum() and c not in self.breaks)
        signs = some(c for c in self.inner if not c.isalnum())
        # nothing that one of these took would be of use to the next, so nothing is given back
        found = ["\x20++", f"[^\x20{some(self.inner)}]"]
        if signs:
            found.insert(0, f"\x20*+[{signs}]++")
        if plain:
            more = f"(?:[{joins}][{signs}]*+[{plain}]*+)*+" if joins else ""
            found.insert(0, f"\x20*+{f'[{signs}]*+' if signs else ''}[{plain}]++{more}")
        return "|".join(found)


def load(path: str = MODEL) -> Pieces:
    """The ordinary pieces, their scores and the byte pieces of a model file.

    The file must keep white space as it is, begin texts with a space and fall
    back to bytes, or texts would not survive."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm = model.normalizer_spec
    if norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError("the model changes texts or lacks byte pieces")
    kind = model.SentencePiece
    rows, by_byte = [], {}
    for i, p in enumerate(model.pieces):
        if p.type in (kind.NORMAL, kind.USER_DEFINED):
            rows.append((p.piece.replace(SPACE, " "), i, float(p.score)))
        elif p.type == kind.BYTE:
            by_byte[int(p.piece[1:-1], 16)] = i
    return table([r for r in rows if r[0]], [by_byte[b] for b in range(256)])


def table(rows: list[tuple[str, int, float]], bytes_ids: list[int]) -> Pieces:
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    if any(re.search(r"[^\x20]\x20", p) or "\0" in p for p, _, _ in rows):
        raise ValueError("a piece has a space behind other characters, or the character that parts words in lists")
    inner = sorted({c for p, _, _ in rows if len(p) > 1 for c in p} - {" "})
    follows = {p[i + 1] for p, _, _ in rows for i in range(len(p) - 1) if p[i].isalnum()}
    breaks = "".join(c for c in inner if not c.isalnum() and c not in follows)
    unknown = min((s for _, _, s in rows), default=0.0) - UNKNOWN_PENALTY
    return Pieces(rows, bytes_ids, unknown, max((len(p) for p, _, _ in rows), default=1), "".join(inner), breaks)


def viterbi(word: str, scores: dict[str, tuple[int, float]], longest: int, unknown: float) -> list[tuple[int, int, int]]:
    """``(id, start, length)`` of the best segmentation; id -1 has no piece."""
    best = [0.0] + [-math.inf] * len(word)
    back: list[tuple[int, int]] = [(0, 0)] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for length in range(min(longest, end), 0, -1):
            found = scores.get(word[end - length : end])
            if found is None and length > 1:
                continue
            piece, score = found or (-1, unknown)
            if best[end - length] + score > best[end]:
                best[end], back[end] = best[end - length] + score, (piece, length)
    out, at = [], len(word)
    while at:
        piece, length = back[at]
        out.append((piece, at - length, length))
        at -= length
    return out[::-1]


def _lattice(asked: DataFrame, pieces: Pieces) -> DataFrame:
    """The pieces of several characters in the distinct words of each bucket: ``of, no, start, length, id``, where
    ``of`` is the bucket and ``no`` counts the bucket's words in ascending order. ``asked`` has lists of words,
    dealt by bucket; nothing is dealt anew."""
    spark = asked.sparkSession
    # of pieces that are there twice the one with the higher score, as in any other choice
    best: dict[str, tuple[float, int]] = {}
    for piece, i, score in pieces.rows:
        best[piece] = max(best.get(piece, (score, i)), (score, i))
    known = spark.createDataFrame([(p, i) for p, (_, i) in best.items() if len(p) > 1], "piece string, id int")
    # no piece that begins with these characters is longer
    longest: dict[str, int] = {}
    for piece in best:
        if len(piece) >= OPENING:
            longest[piece[:OPENING]] = max(longest.get(piece[:OPENING], 0), len(piece))
    openings = spark.createDataFrame(list(longest.items()), "opening string, longest int")
    every = F.split(F.array_join(F.collect_list("words"), "\0"), "\\x00")
    # with a look at the block, so that both sides read the same deal of the lists
    lists = asked.groupBy("bucket").agg(F.sort_array(F.array_distinct(every)).alias("list"), F.min("block").alias("b")).filter("b is not null")
    several = lists.select("bucket", F.posexplode("list").alias("no", "word")).filter(F.length("word") > 1)
    starts = several.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    starts = starts.join(F.broadcast(openings), F.expr(f"substring(word, start, {OPENING}) = opening"), "left")
    reach = F.least(F.coalesce("longest", F.lit(OPENING - 1)), F.length("word") - F.col("start") + 1)
    spans = starts.withColumn("length", F.explode(F.sequence(F.lit(2), reach)))
    matched = spans.join(F.broadcast(known), F.expr("substring(word, start, length) = piece"))
    return matched.select(F.col("bucket").alias("of"), "no", "start", "length", "id")


def _paths(words: list[str], edges: pa.Table, scores: np.ndarray, pieces: Pieces, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids of all: Viterbi's recurrence, position
    by position, for many words at a time. ``scores`` go by id, the ids of ``single`` by character."""
    single = _single_ids(pieces) if single is None else single
    alone = single[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    opens = np.cumsum(sizes) - sizes
    by_size = np.argsort(sizes, kind="stable")
    place = np.empty_like(by_size)
    place[by_size] = np.arange(len(words))
    # parts of words of like length
    part, first, parts = np.empty(len(words), dtype=np.int64), 0, []
    for k, size in enumerate(sizes[by_size].tolist()):
        if k > first and (k - first + 1) * (size + 1) > CELLS:
            parts.append((first, k))
            first = k
        part[k] = len(parts)
    parts.append((first, len(words)))
    where = place[edges.column("no").to_numpy()]
    length = edges.column("length").to_numpy().astype(np.int64)
    end = edges.column("start").to_numpy() + length - 1
    ids = edges.column("id").to_numpy()
    span = int(sizes.max()) + 1
    key = (part[where] * span + end) * span + length
    order = np.argsort(key, kind="stable")
    where, length, end, ids, key = where[order], length[order], end[order], ids[order], key[order]
    step = np.flatnonzero(np.diff(key)) + 1
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in zip([0, *step.tolist()], [*step.tolist(), len(where)]):
        if a < b:
            groups.setdefault((int(part[where[a]]), int(end[a])), []).append((a, b))
    who, at, chosen = [], [], []
    for k, (first, last) in enumerate(parts):
        rows, widest = last - first, int(sizes[by_size[last - 1]])
        best = np.full((widest + 1, rows), -np.inf)
        best[0] = 0.0
        back = np.ones((widest + 1, rows), dtype=np.int32)
        piece = np.full((widest + 1, rows), -1, dtype=np.int32)
        for e in range(1, widest + 1):
            # what stands behind a word's end is never looked at
            ones = alone[np.minimum(opens[by_size[first:last]] + e - 1, len(alone) - 1)]
            piece[e], best[e] = ones, best[e - 1] + np.where(ones >= 0, scores[ones], pieces.unknown)
            for a, b in groups.get((k, e), []):  # shorter pieces first
                n, w = int(length[a]), where[a:b] - first
                sums = best[e - n][w] + scores[ids[a:b]]
                wins = slice(None) if n == 1 else sums >= best[e][w]
                w = w[wins]
                best[e, w], back[e, w], piece[e, w] = sums[wins], n, ids[a:b][wins]
        row, pos = np.arange(rows), sizes[by_size[first:last]]
        while len(row):
            who.append(by_size[first + row])
            at.append(pos)
            chosen.append(piece[pos, row])
            pos = pos - back[pos, row]
            row, pos = row[pos > 0], pos[pos > 0]
    word, at, chosen = np.concatenate(who), np.concatenate(at), np.concatenate(chosen)
    order = np.argsort(word * span + at, kind="stable")
    word, at, chosen = word[order], at[order], chosen[order]
    # characters without a piece
    odd = np.flatnonzero(chosen < 0)
    spelled = [[pieces.bytes_ids[x] for x in words[w][p - 1].encode()] for w, p in zip(word[odd].tolist(), at[odd].tolist())]
    counts = np.ones(len(word), dtype=np.int64)
    counts[odd] = [len(x) for x in spelled]
    flat = np.repeat(chosen, counts)
    flat[flat < 0] = [i for x in spelled for i in x]
    return np.bincount(word, weights=counts, minlength=len(words)).astype(np.int64), flat


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with the numbers ``wanted``, one after the other."""
    some = sizes[wanted]
    ends = np.cumsum(some)
    return flat[np.repeat(starts[wanted] - ends + some, some) + np.arange(ends[-1] if len(ends) else 0)]


def _single(pieces: Pieces) -> frozenset[str]:
    return frozenset(p for p, _, _ in pieces.rows if len(p) == 1)


def _single_ids(pieces: Pieces) -> np.ndarray:
    """The id of the piece of each code point, or -1; of two the one with the higher score."""
    ids = np.full(0x110000, -1, dtype=np.int32)
    for _, i, piece in sorted((s, i, p) for p, i, s in pieces.rows if len(p) == 1):
        ids[ord(piece)] = i
    return ids


def _by_id(pieces: Pieces) -> np.ndarray:
    scores = np.full(max((i for _, i, _ in pieces.rows), default=0) + 1, -np.inf)
    for _, i, score in pieces.rows:
        scores[i] = max(scores[i], score)
    return scores


def segment(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, ids`` for a table of distinct, non-empty words (column ``word``)."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(1, math.ceil(total / WORD_CHARS))
    asked = words.select(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"), F.col("word").alias("words"), F.lit(0).alias("block")).repartition(buckets, "bucket")
    scores, single = _by_id(pieces), _single_ids(pieces)

    def listed(asked: pa.Table, edges: pa.Table) -> pa.Table:
        words = sorted(asked.column("words").to_pylist())
        sizes, flat = _paths(words, edges, scores, pieces, single)
        ids = pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sizes).tolist()], pa.int32()), pa.array(flat, pa.int32()))
        return pa.table({"word": pa.array(words, pa.string()), "ids": ids})

    return asked.groupBy("bucket").cogroup(_lattice(asked, pieces).groupBy("of")).applyInArrow(listed, "word string, ids array<int>")


#: Characters that are cut into words at a time, unless a text is longer.
CUT_CHARS = 1_000_000
#: Kinds of characters: letters and digits, signs that may follow them in a word, signs that may not, spaces, the rest.
PLAIN, JOINS, BREAKS, BLANK, ALONE = range(5)


def _kinds(pieces: Pieces) -> np.ndarray:
    """The kind of each code point."""
    kinds = np.full(0x110000, ALONE, dtype=np.uint8)
    for c in pieces.inner:
        kinds[ord(c)] = PLAIN if c.isalnum() else BREAKS if c in pieces.breaks else JOINS
    kinds[ord(" ")] = BLANK
    return kinds


def _cut(texts: list[str], kinds: np.ndarray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The words of all texts, as ``Pieces.pattern`` finds them, and how many each text has."""
    parts, first, size = [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CUT_CHARS or k == len(texts) - 1:
            parts.append(_cut_part(texts[first : k + 1], kinds))
            first, size = k + 1, 0
    counts = [np.zeros(0, dtype=np.int64), *(c for _, c in parts)]
    return pa.chunked_array([w for w, _ in parts], pa.large_string()), np.concatenate(counts)


def _cut_part(texts: list[str], kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Where a word begins is told by a character and the one before it."""
    whole = "".join(texts)
    data = whole.encode()
    kind = kinds[np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    begins = np.zeros(len(kind) + 1, dtype=bool)
    here, before = kind[1:], kind[:-1]
    begins[1:-1] = (here == ALONE) | (before == ALONE) | ((here == BLANK) & (before != BLANK)) | ((here == BREAKS) & (before == PLAIN))
    begins[0], begins[ends] = True, True  # the last one ends the last word
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    if len(data) > len(whole):  # from characters to bytes
        starts = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
        at = np.append(starts, len(data))[at]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)), counts


def _lists(words: pa.Array, known: frozenset[str], buckets: int) -> dict[int, np.ndarray]:
    """Where in ``words``, which are distinct, those to ask for are, by the bucket of their
    hash, in the order of the hash: not those that are longer than ``LONG``, nor single
    characters without a piece."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(sizes == 1)
    single = words.take(pa.array(odd)).to_pylist()
    asked = sizes <= LONG
    asked[odd] = [w in known for w in single]
    place = np.flatnonzero(asked)
    if not len(place):
        return {}
    plain = words.take(pa.array(place)).to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(plain, categorize=False)
    order = np.argsort(hashes)
    if not np.diff(hashes[order]).all():  # of equal hashes the smaller word first
        order = np.array(sorted(range(len(plain)), key=lambda k: (hashes[k], plain[k])))
    bucket = (hashes[order] % np.uint64(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    place, bucket = place[order][by_bucket], bucket[by_bucket]
    step = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
    return {int(bucket[a]): place[a:b] for a, b in zip([0, *step], [*step, len(place)])}


def _asked(pieces: Pieces, block: str, packed: str, buckets: int):
    kinds, known = _kinds(pieces), _single(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        seen: dict[int, pa.Array] = {}
        for batch in batches:
            texts: dict[int, list[str]] = {}
            for b, value in zip(batch.column(block).to_pylist(), batch.column(packed)):
                if value.is_valid and (text := _unpacked(unpack, value.as_py())):
                    texts.setdefault(b, []).append(text)
            for b in list(texts):
                words = _cut(texts.pop(b), kinds)[0].unique()
                seen[b] = pa.chunked_array([seen[b], words]).unique() if b in seen else words
        for b in list(seen):
            words = seen.pop(b)
            lists = _lists(words, known, buckets)
            data = ["\0".join(words.take(pa.array(places)).to_pylist()) for places in lists.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b] * len(lists), pa.int64()), pa.array(list(lists), pa.int64()), pa.array(data, pa.string())], ["block", "bucket", "words"]
            )

    return run


def _answered(pieces: Pieces):
    scores, single, pieces = _by_id(pieces), _single_ids(pieces), pieces._replace(rows=[])  # the lattice has the others

    def run(asked: pa.Table, edges: pa.Table) -> pa.Table:
        """The ids of the words of each list, in the order of the list: how many for
        each word, and all of them."""
        pack = zstandard.ZstdCompressor(level=3)
        lists = [words.split("\0") for words in asked.column("words").to_pylist()]
        words = sorted(set().union(*lists))
        numbers = dict(zip(words, range(len(words))))
        counts, flat = _paths(words, edges, scores, pieces, single)
        starts = np.cumsum(counts) - counts
        sizes, ids = [], []
        for words in lists:
            wanted = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
            sizes.append(pack.compress(counts[wanted].astype(np.uint16).tobytes()))
            ids.append(pack.compress(_gathered(flat, starts, counts, wanted).astype(np.int32).tobytes()))
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return run


def _unpacked(unpack, packed: bytes) -> str:
    text = unpack.decompress(packed).decode()
    return " " + text if text else ""


def _assembled(pieces: Pieces, packed: str, text: str, names: list[str], schema: pa.Schema, buckets: int):
    pattern, known = pieces.pattern(), _single(pieces)
    rows = pickle.dumps(pieces.rows)  # few blocks need them
    pieces = pieces._replace(rows=[])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        find, unpack = re.compile(pattern).findall, zstandard.ZstdDecompressor()
        texts, parts, counts = [], [], []
        for value in docs.column(packed):
            whole = _unpacked(unpack, value.as_py()) if value.is_valid else None
            words = [] if whole is None else find(whole)
            texts.append(None if whole is None else whole[1:])
            parts.append(pa.array(words, pa.large_string()))
            counts.append(len(words))
            del words
        plain = pa.array(texts, pa.string())
        del texts
        words = pa.chunked_array(parts, pa.large_string()).dictionary_encode().combine_chunks()
        del parts
        coded, every = words.indices.to_numpy(), words.dictionary
        del words
        lists = _lists(every, known, buckets)
        sizes, starts, flat, taken = np.zeros(len(every), dtype=np.int64), np.zeros(len(every), dtype=np.int64), [], 0

        def put(wanted: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
            nonlocal taken
            sizes[wanted], starts[wanted] = counts, taken + np.cumsum(counts) - counts
            flat.append(ids)
            taken += len(ids)

        for bucket, found, ids in zip(*(answers.column(c).to_pylist() for c in ("bucket", "sizes", "ids"))):
            put(lists.pop(bucket), np.frombuffer(unpack.decompress(found), dtype=np.uint16).astype(np.int64), np.frombuffer(unpack.decompress(ids), dtype=np.int32))
        del lists
        scores: dict[str, tuple[int, float]] = {}
        for k in np.flatnonzero(sizes == 0).tolist():  # long words, and characters without a piece
            scores = scores or {p: (i, s) for p, i, s in pickle.loads(rows)}
            w = every[k].as_py()
            path = viterbi(w, scores, pieces.longest, pieces.unknown)
            spelled = [[i] if i >= 0 else [pieces.bytes_ids[x] for x in w[at : at + n].encode()] for i, at, n in path]
            ids = np.array([i for p in spelled for i in p], dtype=np.int32)
            put(np.array([k]), np.array([len(ids)]), ids)
        del every
        ids = _gathered(np.concatenate([*flat, np.zeros(0, dtype=np.int32)]), starts, sizes, coded)
        # where each text's ids begin: after those of all words before it
        before = np.concatenate([[0], np.cumsum(sizes[coded])])[np.concatenate([[0], np.cumsum(counts)])]
        found = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()), mask=plain.is_null())
        columns = []
        for name, field in zip(names, schema):
            if name == text:
                columns.append(plain)
            elif field.name == schema.names[-1]:
                columns.append(found)
            else:
                columns.append(docs.column(name).cast(field.type))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def tidy(docs: pa.Table, answers: pa.Table) -> pa.Table:
        try:
            return run(docs, answers)
        finally:  # what a block took stands next to the executor's heap, so it is given back
            pa.default_memory_pool().release_unused()

    return tidy


@F.pandas_udf(T.BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: None if t is None else pack.compress(t.encode()))


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of ``docs`` and ``ids``."""
    docs = docs.drop(ids)
    total = docs.agg(F.sum(F.length(F.col(quoted(text))))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    block, packed = unused(docs, "_block"), unused(docs, "_packed")
    hashable = [F.col(quoted(f.name)) for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    dealt = (
        docs.withColumn(block, F.pmod(F.xxhash64(*hashable), F.lit(blocks)))
        .withColumn(packed, _pack(F.col(quoted(text))))
        .drop(text)
        # as many parts as the grouping below would be dealt into, so that it needs no further deal
        .repartition(max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), block)
    )
    buckets = max(blocks, math.ceil(total / WORD_CHARS))
    asked = dealt.mapInArrow(_asked(pieces, block, packed, buckets), "block bigint, bucket bigint, words string")
    # one deal of the lists serves the lattice and the answers
    asked = asked.repartition(buckets, "bucket")
    lattice = _lattice(asked, pieces).groupBy("of")
    answers = asked.groupBy("bucket").cogroup(lattice).applyInArrow(_answered(pieces), "block bigint, bucket bigint, sizes binary, ids binary")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [*docs.columns, ids]
    assemble = _assembled(pieces, packed, text, names, to_arrow_schema(schema), buckets)
    return dealt.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(assemble, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``, the text of ``ids``. Unknown and control ids stand for
    nothing; bytes that are no UTF-8 become replacement characters."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as file:
        proto.ParseFromString(file.read())
    kind = proto.SentencePiece
    parts = [
        p.piece.replace(SPACE, " ").encode() if p.type in (kind.NORMAL, kind.USER_DEFINED) else bytes([int(p.piece[1:-1], 16)]) if p.type == kind.BYTE else b""
        for p in proto.pieces
    ]
    plain = _joined(parts)(F.col(quoted(ids)))
    # the space that was put before the text
    plain = F.when(plain.startswith(F.lit(b" ")), F.substr(plain, F.lit(2))).otherwise(plain)
    return encoded.withColumn(to, F.make_valid_utf8(plain.cast("string")))


def _joined(parts: list[bytes]):
    """The bytes of the pieces with these ids; the table goes with the function, not
    into the plan, whose text the driver keeps for every change of it."""

    n = len(parts)

    def some(ids: pa.Array, table: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        flat = pc.fill_null(ids.flatten(), -1).to_numpy()
        # a character's bytes may come from several pieces
        taken = table.take(pa.array(np.where((flat >= 0) & (flat < n), flat, n)))
        at = np.frombuffer(taken.buffers()[1], dtype=np.int32)[: len(taken) + 1]
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at[ends]), taken.buffers()[2]])
        return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.binary()))

    @F.arrow_udf(T.BinaryType())
    def joined(ids: pa.Array) -> pa.Array:
        table = pa.array([*parts, b""], pa.binary())
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
        # few rows at a time, unless one has more ids
        step = np.flatnonzero(np.diff(sizes // DECODED_IDS)) + 1
        found = [some(ids.slice(a, b - a), table) for a, b in zip([0, *step.tolist()], [*step.tolist(), len(ids)])]
        try:
            return pa.concat_arrays(found)
        finally:
            del found
            pa.default_memory_pool().release_unused()

    return joined


ship(__name__)
