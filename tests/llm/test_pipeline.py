import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quarryline.llm import mixing, queries, simhash, toxicity

D = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D).cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        had = {r.doc_id: r for r in docs.collect()}
        assert out.count() == len(ids) and ids <= set(had)
        if name != "pieces":
            assert out.columns == docs.columns
            assert all(had[r.doc_id] == r for r in out.collect())
        gone = set(had) - ids
        if name == "language":
            assert not [d for d in gone if any(map(str.isalpha, had[d].text))]
        if name == "toxicity":
            index = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{D}/labels.parquet"))
            assert gone == {d for d, r in had.items() if index.score([r.text])[0][0] >= toxicity.THRESHOLD} and gone
        if name == "near_dedup":
            fps = {d: simhash.simhash(r.text) for d, r in had.items()}
            close = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2
            assert gone and all(any(close(d, o) for o in had if o < d) for d in gone)
            assert not any(close(a, b) for a in ids for b in ids if a < b)
        if name in ("mix", "pieces"):
            assert not gone
        docs = out
    assert docs.where(~F.col("round_trip")).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, D).columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]


def test_run_gives_the_mixed_order(spark):
    # Several part files of unlike sizes, as larger tables give.
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = [r.doc_id for r in corpus_pipeline.run(spark, D).select("doc_id").collect()]
    finally:
        spark.conf.unset(coalesce)
    kept = spark.read.parquet(f"{D}/documents.parquet").join(spark.createDataFrame([(i,) for i in got], "doc_id long"), "doc_id")
    order = mixing.mix_order(kept, queries.PARTS, queries.DEFAULT_PARTS, queries.BLOCK_ROWS).orderBy("mix_position")
    assert got == [r.doc_id for r in order.select("doc_id").collect()] and len(got) > 500


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, LANG_PRED int, mix_slot int, `__id` int"


def small(tmp_path, spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and clashing names, through all stages and against each operator."""
    rng = random.Random(9)
    vocabulary = {"en": "the of and to in that house river stone".split(), "de": "der die und das mit nicht haus fluss stein".split()}
    text = lambda i, lang: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "er", "ing"]) for _ in range(60)) + (" idiot scum moron" * 3 if i % 10 == 3 else "")
    rows = [(i, text(i, lang), lang, f"s{i % 3}", 1, "t", 7, 8, 9) for i in range(200) for lang in [("en", "de")[i % 2]]]
    rows += [rows[5], rows[5], (900, rows[8][1], None, None, None, None, None, None, None), (901, None, None, None, None, None, None, None, None), (902, "", "en", "s1", 0, "t", 1, 2, 3), (903, "12 34", "en", "s1", 0, "t", 1, 2, 3)]
    rows += [(904, " ".join(rng.choice(vocabulary["en"]) for _ in range(60_000)), "en", "s9", 1, "t", 7, 8, 9), (None, text(0, "en"), "en", "s1", 1, "t", 7, 8, 9)]
    docs = small(tmp_path, spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        got, had = Counter(map(tuple, out.collect())), Counter(map(tuple, docs.collect()))
        assert not got - had
        gone = {r[0] for r in (had - got)}
        if name == "language":
            assert gone >= {901, 902, 903} and len(gone) < 8
        if name == "toxicity":
            assert {i for i in range(200) if i % 10 == 3} <= gone and len(gone) < 30
        if name == "near_dedup":
            assert gone >= {900} and got[rows[5]] <= 1
        if name == "mix":
            assert got == had
        docs = out
    left = {r[0] for r in docs.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left and len(out) == docs.count() and all(r.round_trip for r in out)


def test_empty_table(spark, tmp_path):
    small(tmp_path, spark, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
