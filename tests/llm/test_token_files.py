import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.llm import token_files

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_files.model_path())


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(library):
    encoder = token_files.Encoder(token_files.model_path())
    random.seed(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", " ", "᠎", "​", "﻿", "\x1c", "\x85", "'s", "'", "12", "!", "(", "é", "ſ", "日", "　"]
    parts += ["<|endoftext|>", "<|", "\r\n", "word", "the", ".\n", "\U0001f600", "ŉ", "µ"]
    for _ in range(8000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole(library, text), repr(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 3)
    encoder = token_files.Encoder(token_files.model_path())
    for text in ("some words, more words", "and others\nhere", "some words again"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole(library, text)


def check(spark, library, tmp_path, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id bigint, part string, at string, ids string").repartition(3)
    path = f"{tmp_path}/tokens"
    token_files.write(docs, path, **options)
    read = token_files.read(spark, path)
    assert read.columns == ["id", "start", "n_tokens", "ids"]
    got = sorted(read.withColumn("crc", token_files.checksum(F.col("ids"))).collect(), key=lambda r: r.start)
    place = 0
    for r in got:
        assert r.start == place and r.n_tokens == len(r.ids) and r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        place += r.n_tokens
    keys = [r.id for r in got]
    assert keys == sorted(keys, key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, [*whole(library, t), 0]) for i, t, *_ in rows)
    assert sorted((r.id is not None, r.id or 0, r.ids) for r in got) == want


def rows_of(texts):
    return [(i, t, 9, "p", "a", "x") for i, t in texts]


def test_round_trip_through_the_files(spark, library, tmp_path):
    random.seed(4)
    texts = [(i, " ".join(random.choice(["some", "words", "of\nit,", "x" * 40]) for _ in range(random.randint(0, 60)))) for i in range(300)]
    texts += [(300, None), (301, ""), (None, "no id"), (None, None), (7, "again"), (7, "again"), (302, "long words " * 30_000)]
    random.shuffle(texts)
    check(spark, library, tmp_path, rows_of(texts), part_bytes=5_000)


def test_a_third_of_all_rows_share_an_id(spark, library, tmp_path):
    check(spark, library, tmp_path, rows_of([(5, f"text {i}") for i in range(200)] + [(i, "t") for i in range(400)]), part_bytes=300)


def test_an_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id bigint, text string"), f"{tmp_path}/none")
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_row_groups_without_the_document_are_not_read(spark, tmp_path):
    docs = spark.range(0, 20_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write(docs, f"{tmp_path}/many")
    some = token_files.read(spark, f"{tmp_path}/many", ids=[8_000])
    assert [(r.id, r.start, r.ids[-1]) for r in some.collect()] == [(8_000, 4_000 * 3, 0)]
    # without the filter itself, the scan gives the rows of the row groups that may hold the id
    scan = spark.read.orc(f"{tmp_path}/many").filter("id = 8000")
    plan = scan._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    rows = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 0 < rows <= 2 * token_files.ROWS_PER_INDEX
    odd = spark.read.orc(f"{tmp_path}/many").filter("id = 8001")  # within all ranges, in no Bloom filter
    plan = odd._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value() == 0
