"""Token ids of documents in ORC files, ordered by document id.

Documents are dealt into ranges of their id, each range is tokenized in order
and becomes one file. Its stripes hold the ids with ORC's integer run-length
encoding; row indexes and Bloom filters on the document id let a reader skip
row groups, and a file is read by as many tasks as its stripes allow.

A row is ``id, part, at, n_tokens, ids``: the range, the place within the range
(in ids), how many, and the ids with the end id behind them. The place within
the whole corpus is the place within the range plus the sums of the ranges
before, so nothing is numbered in one task.

Texts are cut before spaces that follow something else than white space. The
tokenizer never merges across such a place (it cuts there itself), so a piece
that was seen before needs no second encoding. All ids come from the library:
a piece of plain letters and signs from its merges, any other from the whole of it.

A null text is an empty one: its only id is the end id. A null document id
comes first. Rows with equal ids stand side by side, ordered by a hash of the
text, and each has its own place. Texts of any length are encoded whole; a row
must fit into a task. An empty table gives no rows. Columns beside the two used
are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import json
import math
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted
from wireloom.sources.staging import materialize

END_ID = 0
#: What the shorter way for plain words relies on; with another one every piece goes through the library as it is.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Bytes of text in one file, on average.
PART_BYTES = 24_000_000
STRIPE_BYTES = 8 << 20
ROWS_PER_INDEX = 1_000
#: Pieces remembered by a Python worker, over all its tasks; beyond that it forgets all and goes on.
MEMORY = 800_000
BATCH_IDS = 2_000_000

#: White space in other tables than Python's.
_LATER_WHITE = "\u180e\u200b\ufeff"
#: Letters of two blocks, then ASCII signs other than the apostrophe and those of control marks, and once more behind
#: a line feed: the tokenizer cuts where one of these kinds ends and nowhere else.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "!-&(-/:;=?@\\[-`{}~"
_PLAIN = re.compile(f"([{_LETTERS}]*)([{_SIGNS}]*)(?:(?<=.)\n([{_LETTERS}]+)([{_SIGNS}]*))?").fullmatch
#: The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on
#: (so U+0120 for a space).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NO_PLAIN_LETTER = "\u0180"
_AS_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ends_in_white(piece: str) -> bool:
    """Also of an empty one, which lies between two spaces."""
    return piece[-1:].isspace() or piece[-1:] in _LATER_WHITE


def pieces_of(text: str) -> list[str]:
    """``text`` cut before every space that follows something else than white space; the
    pieces lack that space, but for the first."""
    first, *parts = text.split(" ")
    out = [first]
    for part in parts:
        if ends_in_white(out[-1]):  # a run of white space stays together
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Encoder(dict):
    """Ids of texts as little-endian bytes, four for each id; a dictionary of the
    pieces seen, each with a space before it. A piece with white space at its end
    can't be told from what follows: it stands for None."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(model)
        self.merges = self.library.model.tokenize
        #: Letters or signs that follow another kind without a space.
        self.bare: dict[str, bytes] = {}
        self.plain = json.loads(self.library.to_str())["pre_tokenizer"] == PRE_TOKENIZER

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, word: str, lead: str) -> bytes:
        """The ids of a string that the tokenizer doesn't cut; ``lead`` comes first."""
        chars = word if word.isascii() and word != "\n" else "".join([_AS_CHARS[b] for b in word.encode()])
        return array("I", [t.id for t in self.merges(lead + chars)]).tobytes()

    def _bare(self, word: str) -> bytes:
        found = self.bare.get(word)
        if found is None:
            found = self.bare[word] = self._merged(word, "")
        return found

    def __missing__(self, piece: str) -> bytes | None:
        if not self.plain:
            out = None if ends_in_white(piece) else self._library(" " + piece)
        elif piece.isalpha() and max(piece) < _NO_PLAIN_LETTER:
            out = self._merged(piece, _AS_CHARS[32])
        elif piece and (parts := _PLAIN(piece)):
            letters, signs, more, signs_behind = parts.groups()
            if letters:
                out = self[letters] + (self._bare(signs) if signs else b"")
            else:
                out = self._merged(signs, _AS_CHARS[32])
            if more is not None:
                out += self._bare("\n") + self._bare(more) + (self._bare(signs_behind) if signs_behind else b"")
        else:
            out = None if ends_in_white(piece) else self._library(" " + piece)
        self[piece] = out
        return out

    def _first(self, piece: str) -> bytes:
        if self.plain and piece.isalpha() and max(piece) < _NO_PLAIN_LETTER:
            return self._bare(piece)
        return self._library(piece)

    def encode(self, text: str) -> bytes:
        if len(self) + len(self.bare) > MEMORY:
            self.clear()
            self.bare.clear()
        first, *rest = text.split(" ")
        if not ends_in_white(first):
            try:
                return self._first(first) + b"".join(map(self.__getitem__, rest))
            except TypeError:  # a run of white space
                pass
        first, *rest = pieces_of(text)
        return self._library(first) + b"".join([self[p] or self._library(" " + p) for p in rest])


def _encoder(model: str) -> Encoder:
    """One for each Python process, whatever number of tasks it serves."""
    kept = vars(sys.modules.setdefault("_wireloom_encoders", types.ModuleType("_wireloom_encoders")))
    if model not in kept:
        kept[model] = Encoder(model)
    return kept[model]


def _tokenize(model: str, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _encoder(model), np.array([end_id], dtype="<u4").tobytes()
        at, names, documents, rows, held = 0, None, [], [], 0

        def batch() -> pa.RecordBatch:
            nonlocal at
            counts = np.array([len(r) // 4 for r in rows], dtype=np.int64)
            ends = np.cumsum(counts)
            flat = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)
            columns = [pa.array(documents, id_type), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), ids]
            at += int(counts.sum())
            documents.clear(), rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "at", "n_tokens", "ids"])

        gc.disable()  # nothing here is cyclic, and a walk over all pieces seen takes long
        try:
            for found in batches:
                for i, text in zip(found.column(0), found.column(1)):
                    documents.append(i.as_py())
                    rows.append(encoder.encode(text.as_py() or "") + end)
                    held += len(rows[-1]) // 4
                    if held >= BATCH_IDS:
                        yield batch()
                        held = 0
            if rows:
                yield batch()
        finally:
            gc.enable()

    return run


def write(docs: DataFrame, path: str, model: str | None = None, end_id: int = END_ID, id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of ``docs`` below ``path``, a folder that all machines share."""
    narrow = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    key = narrow.schema["id"].dataType
    # rows of one id may fill several ranges: the hash of the text and the row's place in the scan order them
    order = ["id", "_hash", "_row"]
    dealt = narrow.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    schema = T.StructType(
        [
            T.StructField("id", key),
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    found = dealt.mapInArrow(_tokenize(model or model_path(), end_id, to_arrow_type(key)), schema)
    found = found.select("id", F.spark_partition_id().alias("part"), "at", "n_tokens", "ids")
    options = {
        "orc.compress": "ZSTD",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.row.index.stride": str(ROWS_PER_INDEX),
        "orc.bloom.filter.columns": "id",
        "orc.bloom.filter.fpp": "0.01",
    }
    found.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, ids: Iterable | None = None) -> DataFrame:
    """``id, start, n_tokens, ids`` of the files below ``path``, of the documents
    ``ids`` only where they are given: row groups without them are skipped. The
    sums of the ranges are taken from the two columns of numbers, not from the ids."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each file; written, so that its size is known where it is joined
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "token-ranges")
    if ids is not None:
        rows = rows.filter(F.col("id").isin(list(ids)))
    return rows.join(bases, "part").select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checksum(ids: Column) -> Column:
    """CRC-32 of the ids as unsigned numbers of four bytes, least byte first."""

    def arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.values.to_numpy(zero_copy_only=False), dtype="<u4").view(np.uint8)
            ends = batch.offsets.to_numpy().astype(np.int64) * 4
            yield pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    arrays.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(arrays, "bigint")(ids)


ship(__name__)
