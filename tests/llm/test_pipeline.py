"""The pipeline's stages on a small corpus, and the registration of all queries."""

import pytest

import corpus_pipeline
from tests.llm.brute import near, personal
from wireloom.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "").cache())
    return [df.collect() for df in out], [df.columns for df in out]


def test_every_stage_decides_on_all_its_predecessor_kept(stages):
    (docs, good, once, clean, mixed, encoded), columns = stages
    assert columns[:5] == [COLUMNS] * 5 and columns[5] == [*COLUMNS, "token_ids", "round_trip"]
    assert 0 < len(good) < len(docs) and {r.doc_id for r in good} < {r.doc_id for r in docs}
    for r in good:
        stats = dict(zip(quality.STATS, quality.text_stats(r.text)))
        assert stats["n_words"] >= 50 and stats["n_repeat_words"] * 2 <= stats["n_words"]
    found = near([(r.doc_id, r.text) for r in good], 5, 80)
    assert sorted(r.doc_id for r in once) == sorted(i for i, (_, c) in found.items() if i == c)
    assert [r.doc_id for r in clean] == [r.doc_id for r in once]
    assert not any(personal(r.text) for r in clean)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert max(sum(r.doc_id == i for r in mixed) for i in {r.doc_id for r in mixed}) <= 2
    assert len(encoded) == len(mixed) and all(r.round_trip and r.token_ids for r in encoded)


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
