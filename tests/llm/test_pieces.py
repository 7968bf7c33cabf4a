import random
import re
import types

import pyarrow as pa
import pytest
import zstandard

from wireloom.llm import pieces

MODEL = pieces.MODEL


@pytest.fixture(scope="module")
def model():
    return pieces.load(MODEL)


def test_viterbi_finds_the_best_of_all_segmentations():
    random.seed(6)
    alphabet = "ab "
    for _ in range(200):
        rows = {"".join(random.choice(alphabet) for _ in range(random.randint(1, 3))).lstrip() or "a" for _ in range(8)}
        scores = {p: (i, -random.random() * 5) for i, p in enumerate(sorted(rows))}
        word = "".join(random.choice("abc") for _ in range(random.randint(1, 8)))

        def best(at):
            if at == len(word):
                return 0.0
            options = []
            for n in range(1, 4):
                got = scores.get(word[at : at + n]) if at + n <= len(word) else None
                if got or (n == 1):
                    options.append((got[1] if got else -20.0) + best(at + n))
            return max(options)

        path = pieces.viterbi(word, scores, 3, -20.0)
        assert "".join(word[a : a + n] for _, a, n in path) == word
        total = sum(scores[word[a : a + n]][1] if i >= 0 else -20.0 for i, a, n in path)
        assert total == pytest.approx(best(0))


def words():
    random.seed(7)
    made = {" " * random.randint(0, 3) + "".join(random.choice("thesandio,.é") for _ in range(random.randint(1, 14))) for _ in range(400)}
    return sorted(w for w in made if w) + ["☃", "日", "\n", "\U0001f600"]


def test_the_lattice_in_spark_gives_the_same_as_the_plain_recurrence(spark, model):
    scores = {p: (i, s) for p, i, s in model.rows}
    rows = pieces.segment(spark.createDataFrame([(w,) for w in words()], "word string"), model).collect()
    assert len(rows) == len(words())
    for r in rows:
        path = pieces.viterbi(r.word, scores, model.longest, model.unknown)
        want = [x for i, a, n in path for x in ([i] if i >= 0 else [model.bytes_ids[b] for b in r.word[a : a + n].encode()])]
        assert r.ids == want, r.word


def test_words_are_encoded_as_by_the_library_with_these_scores(spark, model):
    """The library adds in single precision, so the few scores of -1e9 are raised for both."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # unigram: the best sum of scores
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    raised = pieces.table([(p, i, max(s, -40_000.0)) for p, i, s in model.rows], model.bytes_ids)
    asked = [" " + w.strip() for w in words() if w.strip()]
    got = {r.word: r.ids for r in pieces.segment(spark.createDataFrame([(w,) for w in set(asked)], "word string"), raised).collect()}
    for w in asked:
        if not set(w[1:]) - set(model.inner):
            assert got[w] == library.encode(w[1:]), w


def test_texts_survive(spark, model):
    texts = ["Hello   world\n日本 ▁ \U0001f600 a", "", None, "x" * 3000 + " end", " lead", "  ", "tab\tand\r\nlines", "the cat " * 4000, "▁", "dup", "dup"]
    rows = [(i if i < 9 else 9, t, "old", [1.5]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, extra array<double>").repartition(3)
    encoded = pieces.encode(docs, model, block_chars=4000)
    out = pieces.decode(encoded).collect()
    assert encoded.columns == ["doc_id", "text", "extra", "ids"]
    assert sorted((r.doc_id, r.text or "") for r in out) == sorted((i, t or "") for i, t, _, _ in rows)
    for r in out:
        assert r.decoded == r.text and (r.ids is None) == (r.text is None) and r.extra == [1.5]
    assert [r.ids for r in out if r.text == ""] == [[]]


def test_empty_table(spark, model):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pieces.decode(pieces.encode(empty, model)).count() == 0


def test_a_table_whose_words_cant_be_cut_is_refused():
    with pytest.raises(ValueError):
        pieces.table([("a b", 0, -1.0)], list(range(256)))


def test_many_words_at_once_take_the_paths_of_single_ones(monkeypatch):
    random.seed(8)
    alphabet = "abé "
    rows = {"".join(random.choice(alphabet) for _ in range(random.randint(1, 4))).lstrip() for _ in range(25)} - {"", "é"}
    # few different scores, so that sums are equal
    small = pieces.Pieces([(p, i, float(-random.randint(1, 3))) for i, p in enumerate(sorted(rows))], list(range(100, 356)), -20.0, 4, "ab", "")
    scores = {p: (i, s) for p, i, s in small.rows}
    asked = sorted({"".join(random.choice("abcé") for _ in range(random.randint(1, 30))) for _ in range(300)})
    edges = [(k, at + 1, n, scores[w[at : at + n]][0]) for k, w in enumerate(asked) for at in range(len(w)) for n in range(1, min(4, len(w) - at) + 1) if w[at : at + n] in scores]
    random.shuffle(edges)
    found = pa.table({c: pa.array(v, pa.int32()) for c, v in zip(("no", "start", "length", "id"), zip(*edges))})
    want = [[x for i, at, n in pieces.viterbi(w, scores, 4, -20.0) for x in ([i] if i >= 0 else [100 + b for b in w[at : at + n].encode()])] for w in asked]
    for cells in (pieces.CELLS, 100):
        monkeypatch.setattr(pieces, "CELLS", cells)
        sizes, flat = pieces._paths(asked, found, pieces._by_id(small), small)
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
    sizes, flat = pieces._paths(["é", "é" * 2], found.slice(0, 0), pieces._by_id(small), small)
    assert sizes.tolist() == [2, 4] and flat.tolist() == [100 + b for b in "ééé".encode()]


def test_a_block_cuts_each_text_once(model, monkeypatch):
    seen = []

    class Counted:
        def __init__(self, pattern):
            self.find = re.compile(pattern).findall

        def findall(self, text):
            seen.append(text)
            return self.find(text)

    monkeypatch.setattr(pieces, "re", types.SimpleNamespace(compile=Counted, escape=re.escape))
    texts = ["the cat", "", None, "a ☃ cat"]
    pack = zstandard.ZstdCompressor().compress
    docs = pa.table({"t": pa.array([t if t is None else pack(t.encode()) for t in texts], pa.binary())})
    none = pa.table({"bucket": pa.array([], pa.int64()), "sizes": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    schema = pa.schema([("text", pa.string()), ("ids", pa.list_(pa.int32()))])
    out = pieces._assembled(model, "t", "text", ["text", "ids"], schema, 1)(docs, none).to_pylist()
    assert [r["text"] for r in out] == texts and len(seen) == 3
    scores = {p: (i, s) for p, i, s in model.rows}
    path = pieces.viterbi(" the", scores, model.longest, model.unknown) + pieces.viterbi(" cat", scores, model.longest, model.unknown)
    assert out[0]["ids"] == [i for i, _, _ in path] and out[1]["ids"] == [] and out[2]["ids"] is None


def test_texts_are_cut_as_the_pattern_finds_words(model, monkeypatch):
    random.seed(11)
    letters = [*" aZ09.,-'/(é日\n\t☃\U0001f600▁", *model.inner[:8], *model.breaks[:8]]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(600)]
    texts += ["", "  ", "x" * 300, "", " , a,b. c"]
    tables = [model, pieces.table([("ab", 0, -1.0), ("é-a", 1, -1.0), ("a", 2, -1.0)], list(range(3, 259))), pieces.table([], list(range(256)))]
    for some in tables:
        want = [re.findall(some.pattern(), t) for t in texts]
        for chars in (pieces.CUT_CHARS, 50):
            monkeypatch.setattr(pieces, "CUT_CHARS", chars)
            words, counts = pieces._cut(texts, pieces._kinds(some))
            assert counts.tolist() == list(map(len, want))
            assert words.to_pylist() == [w for found in want for w in found]
    words, counts = pieces._cut([], pieces._kinds(model))
    assert len(words) == 0 and len(counts) == 0


def test_decoding_skips_what_is_no_piece_and_leaves_no_table_in_the_plan(spark, model):
    by_piece = {p: i for p, i, _ in model.rows}
    rows = [(0, [by_piece[" the"], None, 10**6, -1, 0]), (1, None), (2, []), (3, [model.bytes_ids[0xE6], model.bytes_ids[0x97], model.bytes_ids[0xA5]]), (4, [model.bytes_ids[0xE6], by_piece["a"]])]
    decoded = pieces.decode(spark.createDataFrame(rows, "doc_id int, ids array<int>"))
    assert {r.doc_id: r.decoded for r in decoded.collect()} == {0: "the", 1: None, 2: "", 3: "日", 4: "\ufffda"}
    # the driver keeps the text of the plan for each of its changes
    assert len(decoded._jdf.queryExecution().toString()) < 20_000


def test_only_pieces_of_several_characters_are_joined(spark, model):
    """Those of single characters need no rows of the lattice."""
    asked = spark.createDataFrame([(0, "a\0 the\0☃"), (1, "b")], "bucket bigint, words string").selectExpr("bucket", "words", "0 as block")
    edges = pieces._lattice(asked, model).collect()
    listed = {(0, k): w for k, w in enumerate(sorted(["a", " the", "☃"]))}
    by_piece = {p: i for p, i, _ in model.rows}
    want = {(of, k, at + 1, n, by_piece[w[at : at + n]]) for (of, k), w in listed.items() for at in range(len(w)) for n in range(2, len(w) - at + 1) if w[at : at + n] in by_piece}
    assert want and {tuple(r) for r in edges} == want and len(edges) == len(want)
    twice = pieces.Pieces([("a", 3, -2.0), ("a", 4, -1.0), ("a", 5, -3.0)], list(range(100, 356)), -20.0, 1, "", "")
    assert pieces._single_ids(twice)[ord("a")] == 4
