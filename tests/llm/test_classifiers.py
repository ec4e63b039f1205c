import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarryline.llm import langid, queries, toxicity
from quarryline.llm.common import training_row

D = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = queries.op5_langid(spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.n == 1000 and r.lo >= 0 and r.hi <= 1
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99


def test_language_edge_cases(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("der die das und", "de"), ("the of and to", "en")] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string")
    m = langid.fit(df)
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "12 %% 漢", "c"), (4, "123 $$", "c"), (5, "THE OF", "c"), (5, "the " * 50000, None), (6, "thx", "c")], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, m).orderBy("doc_id", "text").collect()]
    assert got[:2] == [(1, "und"), (2, "und")] and (4, "und") in got and got.count((5, "en")) == 2 and (6, "en") in got
    assert langid.identify(odd, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(odd.limit(0), m).count() == 0


def test_language_equals_brute_force(spark):
    """Predictions from the definitions: log frequencies of known words, else the mean over known n-grams of the longest order that has any."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efgha"}
    rows = [(i, " ".join(word(letters[lang]) for _ in range(rng.randint(1, 30))), lang) for i in range(300) for lang in [rng.choice(sorted(letters))]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: Counter() for lang in letters}
    for d, t, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            counts[lang].update(t.split())
    langs = sorted(counts)

    def grams(n):
        out = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, k in counts[lang].items():
                for i in range(len(w) + 3 - n):
                    out[lang][f"^{w}$"[i : i + n]] += k
        return out

    table = {n: grams(n) for n in (5, 4, 3, 2, 1)}
    logs = lambda by, x: [math.log((by[lang][x] + 0.5) / (sum(by[lang].values()) + 1)) for lang in langs]

    def of(w):
        if any(w in counts[lang] for lang in langs):
            return logs(counts, w)
        for n, by in table.items():
            known = [logs(by, g) for g in (f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)) if any(g in by[lang] for lang in langs)]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(langs)

    texts = [" ".join(word("abcdefghijk") for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["zzz", "abcd zzz"]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for r in got:
        total = [sum(x) for x in zip(*[of(w) for w in texts[r.doc_id].split()])]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        score = 1 / sum(math.exp(x - total[best]) for x in total)
        assert abs(r.lang_score - score) < 1e-9 and (r.lang_pred == langs[best] or abs(sorted(total)[-1] - sorted(total)[-2]) < 1e-9)


def test_language_ties_names_and_repeats(spark):
    rows = [(i, "same words", lang) for i in range(60) for lang in ("xx", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "same words", 5, "s")] * 2, "doc_id long, text string, Lang_Pred int, lang_score string")
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "lang_score"]
    assert [(r.lang_pred, round(r.lang_score, 9)) for r in got.collect()] == [("xx", 0.5)] * 2


def index_of(examples, *rest):
    ids, labels, rows, counts = zip(*examples)
    words = pa.array([list(c) for c in counts], pa.list_(pa.string()))
    return toxicity.Index(np.array(ids), np.array(labels), np.array(rows), words, np.array([n for c in counts for n in c.values()]), *rest)


def brute_force(examples, share_rows, text):
    """Cosines of a text with all examples, from the definitions: {doc_id: cosine}."""
    n = [sum(y == k for _, y, _, _ in examples) for k in (0, 1)]
    rows = [n[k] * share_rows[k] for k in (0, 1)]
    weight = {}
    for w in {w for *_, c in examples for w in c}:
        df = [sum(w in c for _, y, _, c in examples if y == k) for k in (0, 1)]
        g2 = 0
        for k in (0, 1):
            for x, of_all in ((df[k] + 0.5, df[0] + df[1] + 1), (n[k] + 1 - df[k] - 0.5, n[0] + n[1] + 2 - df[0] - df[1] - 1)):
                g2 += 2 * x * math.log(x / ((n[k] + 1) * of_all / (n[0] + n[1] + 2)))
        weight[w] = math.log((rows[0] + rows[1] + 1) / (df[0] * share_rows[0] + df[1] * share_rows[1])) * math.sqrt(max(g2, 1e-6))

    def vector(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    q = vector(Counter(text.lower().split()))
    return {d: sum(x * q.get(w, 0) for w, x in vector(c).items()) for d, _, _, c in examples}


def test_nearest_and_votes_equal_brute_force():
    rng = random.Random(1)
    words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)]
    some = lambda y: Counter(rng.choices(words[20 * y : 40 + 20 * y], [1 / (i + 1) for i in range(40)], k=rng.randint(1, 25)))
    examples = [(i, y, rng.choice((1.0, 2.0, 5.0)), some(y)) for i in range(900) for y in [int(rng.random() < 0.4)]]
    index = index_of(examples, 0.2, (4.0, 2.0))
    labels, rows = {d: y for d, y, _, _ in examples}, {d: w for d, _, w, _ in examples}
    for _ in range(150):
        text = " ".join(some(rng.randint(0, 1)).elements()) + " unknown"
        cos = brute_force(examples, (4.0, 2.0), text)
        (got, at), = index.nearest([toxicity.terms(text)])
        want = sorted((c for c in cos.values() if c > 1e-12), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose(got, want, atol=1e-9)
        assert np.allclose(got, [cos[index.doc_ids[i]] for i in at], atol=1e-9)
        (score, evidence), = index.score([text])
        assert evidence == [index.doc_ids[i] for i in at] and len(set(evidence)) == len(evidence)
        votes = sum(cos[d] * rows[d] for d in evidence)
        shrink = toxicity.SHRINK * sum((4.0, 2.0)[labels[d]] for d in evidence) / len(evidence)
        assert abs(score - (sum(cos[d] * rows[d] * labels[d] for d in evidence) + shrink * index.base) / (votes + shrink)) < 1e-9


def test_blocks_are_skipped_and_ties_are_stable():
    examples = [(i, i % 2, 1.0, Counter({f"w{chr(97 + i // 200)}": 1, "toxic" if i % 2 else "clean": 1})) for i in range(2000)]
    index = pickle.loads(pickle.dumps(index_of(examples, 0.5)))
    got, again = index.nearest([Counter({"wc": 1, "toxic": 1}), Counter({"toxic": 1, "wc": 1})])
    assert np.allclose(got[0], 1) and all(400 <= index.doc_ids[i] < 600 and index.doc_ids[i] % 2 for i in got[1])
    assert got[1].tolist() == sorted(got[1].tolist()) == again[1].tolist()


def test_toxicity_on_labels(spark):
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.1")
    lab = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in lab.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[(0, 0)] and n.get((1, 0), 0) <= 0.25 * n[(1, 1)], n
    assert got.count() == 10000


def test_toxicity_edge_cases(spark):
    # Near copies count as one example, so these have words of their own.
    own = lambda i: " ".join(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}" for a in "bcdfghjklm")
    rows = [(i, ("you idiot scum " if i % 2 else "a nice day ") + own(i), "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(60)] + [(None, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")
    index = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 30000), (3, "IDIOT!"), (None, "fine")], "doc_id long, text string")
    got = {(r.doc_id, (r.text or "")[:6]): r.toxicity for r in toxicity.rate(odd, index).collect()}
    assert got[3, "idiot "] > 0.5 and got[3, "IDIOT!"] > 0.5 and max(got[1, ""], got[2, ""], got[None, "fine"]) < 0.3
    assert {r.toxicity for r in toxicity.rate(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.rate(odd.limit(0), index).count() == 0


def test_toxicity_of_repeated_rows(spark):
    rows = [(i, "you idiot scum" if i % 2 else "a nice day", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(60)] + [(None, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")
    index = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 30000), (3, "IDIOT!"), (None, "fine")], "doc_id long, text string")
    got = {(r.doc_id, (r.text or "")[:6]): r.toxicity for r in toxicity.rate(odd, index).collect()}
    assert got[3, "idiot "] > 0.5 and got[3, "IDIOT!"] > 0.5 and max(got[1, ""], got[2, ""], got[None, "fine"]) < 0.3
    trained = {r.doc_id for r in labels.where(training_row(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().collect()}
    assert dict(zip(index.labels, index.rows, strict=True)) == {1: sum(i % 2 for i in trained), 0: sum(1 - i % 2 for i in trained)}


def test_toxic_row_like_a_clean_one_stays(spark):
    # Each toxic row is the clean one of the id before it with two words put in, and shares 40 of 42 words with it.
    text = lambda i: " ".join(f"{a}{b}{chr(97 + i % 26)}{chr(97 + i // 26)}" for a in "bcdfghjk" for b in "aeiou")
    rows = [(2 * i + y, text(i) + (" idiot scum" if y else ""), y) for i in range(60) for y in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    trained = {r.doc_id for r in docs.where(training_row(F.col("doc_id")) & (F.col("toxic") == 1)).select("doc_id").collect()}
    assert {d for d, y in zip(index.doc_ids, index.labels, strict=True) if y == 1} == trained


def test_groups_of_copies():
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h k l", "a b c d e f g h i j", "v w x y z", "", ""]
    labels = [1, 1, 1, 0, 1, 1, 1]
    signs = [toxicity._hashes(toxicity.terms(t)) for t in texts]
    # Row 1 is nearer than LIKE to row 0; row 2 only to row 1, which was dropped; row 3 is of the other label.
    one_band = [[b"same"] if len(h) else [] for h in signs]
    rows = [(i, y, b, h) for i, (y, b, h) in enumerate(zip(labels, one_band, signs, strict=True))]
    assert toxicity.group_copies(rows) == {0: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


def test_rare_toxic_words_are_features(spark):
    # Toxic row i has one of 70 toxic words, each in under a fiftieth of the toxic rows, among words of its own.
    own = lambda i: " ".join(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for a in "bcdfghjklm")
    word = lambda i: f"{chr(97 + i % 10)}{chr(97 + i // 10 % 7)}qqqq"
    rows = [(i, own(i) + (f" {word(i // 2)}" if i % 2 else ""), i % 2) for i in range(2800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    new = spark.createDataFrame([(i, f"good day {word(i)}") for i in range(70)] + [(70, "good day")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.rate(new, index).collect()}
    assert sum(got[i] >= toxicity.THRESHOLD for i in range(70)) >= 60 and got[70] < toxicity.THRESHOLD


def test_clashing_names_are_replaced(spark):
    docs = spark.createDataFrame([(i, "you idiot scum" if i % 2 else "a nice day", "en", 9, "e") for i in range(40)], "doc_id long, text string, lang string, TOXICITY int, evidence string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    got = toxicity.rate(docs, index)
    assert got.columns == ["doc_id", "text", "lang", "toxicity", "evidence"] and got.where("toxicity > 0.5").count() == 20
