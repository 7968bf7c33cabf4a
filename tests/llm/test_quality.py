import random

import pytest

from tests.llm.brute import base_stats
from wireloom.llm import quality

GOOD = " ".join(f"word{i} and" for i in range(80))
JUNK = "spam spam spam buy! " * 60


def test_stats_match_brute_force():
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("ab é\t\n#\x0b .") for _ in range(random.randint(0, 60)))
        got = dict(zip(quality.STATS, quality.text_stats(text)))
        want = base_stats(text)
        assert tuple(got[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, repr(text)


def test_votes_outweigh_each_other():
    share, right = quality.fit_label_model([((1, 1, 1), 900), ((1, -1, -1), 90), ((0, 1, -1), 10)], 3)
    assert 0.8 < share < 0.95
    assert right[1][0] > 0.95 and right[1][1] > 0.5


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, GOOD + f" end{i}", "x", "y") for i in range(30)]
    rows += [(100 + i, JUNK + str(i), None, "y") for i in range(6)]
    rows += [(200, None, "x", "y"), (201, "", "x", "y"), (202, "tiny", "x", "y"), (None, GOOD, "x", None), (203, GOOD, "x", "y"), (203, GOOD, "x", "y")]
    rows += [(300, GOOD * 200, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, quality string")
    return df, quality.judge(df.drop("quality")).collect()


def test_verdicts(judged):
    _, rows = judged
    kept = {r.doc_id: r.quality.kept for r in rows if r.doc_id is not None}
    assert all(kept[i] for i in range(30)) and kept[203]
    assert not any(kept[i] for i in (*range(100, 106), 200, 201, 202))
    assert len(rows) == 43 and sum(r.doc_id == 203 for r in rows) == 2
    assert kept[300] is False  # a text repeated 200 times is repetition


def test_keep_good_has_the_same_columns(judged):
    df, _ = judged
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert {r.quality for r in out.collect()} == {"y", None}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.judge(empty).count() == 0
