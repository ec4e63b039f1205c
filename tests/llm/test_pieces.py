import dataclasses
import random

import sentencepiece
from pyspark.sql import functions as F

from quarryline.llm import pieces, queries

MODEL = pieces.load()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
ODD = ["", " ", "  a", "a  b   c", "tab\tnew\nline", "<s>", "<0x41>", "漢字🙂é", "a" * 300, "thethethe" * 20, "    " * 9, "x​y", "UPPER lower123 $%&"]


def test_equals_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD + [None, "word " * 20000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    got = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.token_ids == LIBRARY.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.decoded == (texts[r.doc_id] or "")
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xC3]), (4, [MODEL.ids["▁a"], MODEL.ids["▁a"]]), (5, [1, 0])], "n int, token_ids array<int>")
    assert {r.n: r.decoded for r in pieces.decode(df, MODEL).collect()} == {1: None, 2: "", 3: "\ufffd", 4: "a a", 5: ""}


def slow_merge(word):
    s = list(word)
    while pairs := [(-MODEL.scores[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in MODEL.scores]:
        i = min(pairs)[1]
        s[i : i + 2] = [s[i] + s[i + 1]]
    return s


def test_folds_equal_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("▁thernaoiz漢") for _ in range(rng.randint(2, 14))) for _ in range(2000)} | {"".join(rng.choice("ethnaoi") for _ in range(400))})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    bpe = {r.word: r.pieces.split(" ") for r in pieces.fold(pieces.lattice(df, MODEL), pieces.BPE).collect()}
    assert bpe == {w: slow_merge(w) for w in words if len(slow_merge(w)) < len(w)}
    assert all(MODEL.segment(w) == slow_merge(w) for w in words)
    unigram = dataclasses.replace(MODEL, kind=pieces.UNIGRAM)
    score = lambda s: sum(MODEL.scores.get(p, pieces.UNKNOWN) for p in s)
    short = [w for w in words if len(w) < 10][:300]
    for r in pieces.fold(pieces.lattice(df.where(F.length("word") < 10), unigram), pieces.UNIGRAM).where(F.col("word").isin(short)).collect():
        got = r.pieces.split(" ")
        assert "".join(got) == r.word and abs(score(got) - max(map(score, cuts(r.word)))) < 1e-3
        assert abs(score(got) - score(unigram.segment(r.word))) < 1e-3


def cuts(word):
    """All ways to cut a word."""
    if not word:
        return [[]]
    return [[word[:i], *rest] for i in range(1, len(word) + 1) if i == 1 or word[:i] in MODEL.scores for rest in cuts(word[i:])]


def test_chunks_long_words_and_clashing_names(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 500)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("ethnaoiéz") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["eta" * 700, "eta" * 700]
    df = spark.createDataFrame([(i, t, "c", "w") for i, t in enumerate(texts)], "doc_id long, text string, Token_IDs string, __chunk string")
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    for docs in (spark.read.parquet(str(tmp_path / "d")), df, df.repartition(5)):
        got = pieces.encode(docs, MODEL)
        assert got.columns == ["doc_id", "text", "__chunk", "token_ids"]
        assert {r.doc_id: r.token_ids for r in got.collect()} == {i: LIBRARY.encode(t) for i, t in enumerate(texts)}


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 3 + [(None, None)] * 2, "doc_id long, text string")
    got = [(r.doc_id, tuple(r.token_ids)) for r in pieces.encode(df, MODEL).collect()]
    assert sorted(got, key=str) == sorted([(1, tuple(LIBRARY.encode("same text")))] * 3 + [(None, ())] * 2, key=str)


def test_query_round_trips(spark):
    got = queries.op3_pieces(spark, "/root/testdata/sf0.01")
    assert got.count() == 1000 and got.where("not round_trip").count() == 0
