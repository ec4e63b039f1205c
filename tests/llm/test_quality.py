import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarryline.llm import quality, queries

SCHEMA = "doc_id long, text string, pattern string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    rng, texts = random.Random(5), [None, "", " \t\n\x0b", "one", "a b c d e a b c d e a b", "x " * 7, "é ß 漢字 🙂\n#*$%&|<>", "l1\nl1\n \n \nl1 x\r\nl1 x\r\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["w%d " % i * 3 for i in range(5)]
    texts.append(" ".join(rng.choice(["the", "of", "and", "in", "to", "x"]) for _ in range(30000)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id][:80]


def em(patterns):
    """The fit in plain Python."""
    rules = list(quality.RULES)
    th = [{"share": s} | {r: list(quality.ALARM if r in seen else quality.CALM) for r in rules} for s, seen in quality.CLASSES.values()]
    belief = [{k: list(v) if isinstance(v, list) else v for k, v in t.items()} for t in th]
    votes = {p: {r: p // 3**k % 3 for k, r in enumerate(rules) if p // 3**k % 3} for p in patterns}

    def post(p):
        x = [t["share"] * math.prod(t[r][v - 1] for r, v in votes[p].items()) for t in th]
        return [y / sum(x) for y in x]

    n_all, w = sum(patterns.values()), quality.BELIEF
    for _ in range(quality.ITERATIONS):
        q = {p: post(p) for p in patterns}
        new = []
        for c, b in enumerate(belief):
            mass = lambda keep: sum(n * q[p][c] for p, n in patterns.items() if keep(votes[p]))  # noqa: B023, E731
            t = {"share": (mass(lambda v: True) + b["share"] * w) / (n_all + w)}
            for r in rules:
                t[r] = [(mass(lambda v: v.get(r) == k) + b[r][k - 1] * w) / (mass(lambda v: r in v) + w) for k in (1, 2)]  # noqa: B023
            new.append(t)
        th = new
    return {p: post(p)[0] for p in patterns}


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(1)
    patterns = {p: rng.randint(1, 400) for p in rng.sample(range(3 ** len(quality.RULES)), 60)}
    got = quality.label_model(spark.createDataFrame(list(patterns.items()), "pattern int, n long")).collect()
    want = em(patterns)
    assert len(got) == 60 and all(abs(r.p_fine - want[r.pattern]) < 1e-6 for r in got)


def test_verdicts(spark):
    fine = "Plain words make up this text and it goes on for a while without trouble of any kind.\nAnother line follows here.\nAnd a third one."
    rows = [(1, None, "c", "c"), (2, "", None, None), (3, fine, "", ""), (3, fine, "", ""), (4, " ".join(w + "%%%" for w in fine.split() * 2), "", ""), (5, "spam spam spam spam spam " * 30, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).drop("n", "pattern")
    got = quality.judge(df).collect()
    assert len(got) == 6 and {r.doc_id: r.kept for r in got} == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert quality.judge(df.limit(0)).count() == 0


def test_query_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, d)
    lab = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    hit = {(r.quality, r.kept): r["count"] for r in lab.groupBy("quality", "kept").count().collect()}
    assert hit.get((1, False), 0) <= 0.01 * hit[(1, True)] and hit.get((0, True), 0) <= 0.2 * hit.get((0, False), 1)


def test_judge_with_clashing_names(spark):
    text = "Plain words make up this text and it goes on for a while without trouble of any kind."
    df = spark.createDataFrame([(1, text, 5, "p", [1], "k", 2.5), (2, None, 6, "q", None, None, None)], "doc_id long, text string, N_words int, pattern string, windows array<int>, `__words` string, kept double")
    got = quality.judge(df)
    assert got.columns[:4] == ["doc_id", "pattern", "windows", "__words"] and got.columns[4:] == [*quality.COUNTS, "base_failed", "p_fine", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].pattern, rows[1].windows, rows[1]["__words"], rows[1].n_words, rows[1].kept) == ("p", [1], "k", 18, True)
    assert (rows[2].pattern, rows[2].n_words, rows[2].kept) == ("q", 0, False)
