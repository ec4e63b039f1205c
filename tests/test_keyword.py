import math
import random
import shutil
from collections import Counter

from pyspark.sql import functions as F

from quarryline.operators import keyword

from .test_hot_keys import most_rows


def test_scores_equal_brute_force(spark):
    """Copies, empty and null texts, and rows of one id, of equal and other lengths."""
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))
    some = [text() for _ in range(40)]
    asked = [(q, w) for q in range(5) for w in rng.sample("abcdxyz", 3)] + [(9, "zz")]
    once = [(i, rng.choice([*some, None])) for i in range(300)]
    for rows in (once, once + [(i // 3, rng.choice(some)) for i in range(60)]):
        docs = {}
        for i, t in rows:
            if t is not None:
                docs.setdefault((i, len(t.split())), Counter()).update(t.split())
        whole = [len(t.split()) for _, t in rows if t is not None]
        avgdl, df = sum(whole) / len(whole), Counter(w for c in docs.values() for w in c)
        want = {}
        for q, w in asked:
            for (i, dl), c in docs.items():
                if c[w]:
                    idf = math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
                    want[q, i] = want.get((q, i), 0) + idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * dl / avgdl))
        frame, questions = spark.createDataFrame(rows, "id long, t string").repartition(3), spark.createDataFrame(asked, "query_id long, term string")
        got = keyword.scores(frame, "id", keyword.standard_tokens(F.col("t")), questions).collect()
        assert len(got) == len(want) and all(abs(r.score - want[r.query_id, r.doc]) < 1e-9 for r in got)
        top = keyword.top_k(keyword.scores(frame, "id", keyword.standard_tokens(F.col("t")), questions, k=6), 6).collect()
        best = {(q, n): d for q in {q for q, _ in asked} for n, d in enumerate([d for _, d in sorted((-round(s, 4), d) for (p, d), s in want.items() if p == q)][:6], 1)}
        assert {(r.query_id, r["rank"]): r.doc for r in top} == best
    assert keyword.scores(frame, "id", keyword.standard_tokens(F.col("t")), questions.limit(0)).count() == 0


def test_best_without_a_row_for_each_question_and_document(spark):
    n = 2000
    docs = spark.range(n).selectExpr("id", "concat_ws(' ', transform(sequence(0, int(id % 40)), x -> if(x % 2 = 0, 'a', 'b'))) t").repartition(1)
    questions = spark.range(30).selectExpr("id query_id", "explode(array('a', 'b')) term")
    rows, most = most_rows(keyword.top_k(keyword.scores(docs, "id", keyword.standard_tokens(F.col("t")), questions, k=3), 3))
    assert len(rows) == 90 and most <= n * 5


def test_documents_are_cut_into_tokens_once(spark, tmp_path):
    """Scores come from what was found at first: the documents may be gone by then."""
    spark.range(50).selectExpr("id", "if(id % 2 = 0, 'a b', 'b') t").write.parquet(str(tmp_path / "docs"))
    docs, questions = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(1, "a")], "query_id long, term string")
    got = keyword.scores(docs, "id", keyword.standard_tokens(F.col("t")), questions)
    shutil.rmtree(tmp_path / "docs")
    assert {r.doc for r in got.collect()} == set(range(0, 50, 2))
