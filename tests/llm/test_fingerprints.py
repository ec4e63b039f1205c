import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from quarryline.llm import fingerprints as fp

from ..test_hot_keys import most_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text)
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def jaccard(a, b):
    a, b = bag(a), bag(b)
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def texts():
    rng = random.Random(2)
    out = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 150))) for _ in range(700)]
    out[10] = out[11] = out[12] = "same text here in every way é漢🙂 " * 9
    out[20], out[21], out[22], out[23] = None, "", " \n ", None
    out[30] = " ".join(str(i % 3000) for i in range(9000))
    out[31] = "loop it now and then " * 400
    return out


def test_edits_and_likeness(spark):
    rows = [(i * 7 - 900, t, 1, "x") for i, t in enumerate(texts())]
    rows += [(None, "a null id", 0, None), (rows[50][0], "twice the id, another text", 0, None), rows[60]]
    rows_twice = rows[60][0]
    random.Random(1).shuffle(rows)
    got = fp.with_edited(spark.createDataFrame(rows, "doc_id long, text string, b long, rn string").repartition(5)).collect()
    hashed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = [(a, b, d) for a, b, _, d in sorted((r[0] is not None, r[0] or 0, hashed(r[1] or ""), r[1] or "") for r in rows)]
    want, by_id = [], {}
    for i, (has, doc, text) in enumerate(order):
        k, after = len(text) // 4, order[(i + 1) % len(order)][2]
        edited = text[: len(text) - k] + after[:k]
        want.append((doc if has else None, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        by_id[(doc if has else None, len(text))] = (text, edited, after)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    of_text, off = {}, []
    got = [r for r in got if r.doc_id != rows_twice]  # its copies have different successors
    for r in got:
        text, edited, after = by_id[(r.doc_id, r.n_chars)]
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert of_text.setdefault(tuple(sorted(bag(t).items())), f) == f and len(f) == 8 * fp.SAMPLES
        parts = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
        same = lambda a, b: sum(x == y for x, y in zip(parts(a), parts(b))) / fp.SAMPLES
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        off.append(r.near_edited - jaccard(text, edited))
        assert abs(r.near_next - jaccard(text, after)) < 0.45
        if not bag(text):
            assert r.fingerprint == "0" * 8 * fp.SAMPLES
    assert abs(sum(off) / len(off)) < 0.015 and sum(x * x for x in off) / len(off) < 0.25 / fp.SAMPLES * 2.2
    for r in got:
        i = next(i for i, o in enumerate(order) if (o[1] if o[0] else None) == r.doc_id and len(o[2]) == r.n_chars)
        follower = bag(order[(i + 1) % len(order)][2])
        assert r.near_next == sum(x == y for x, y in zip(parts(r.fingerprint), parts(of_text.get(tuple(sorted(follower.items())), "-" * 8 * fp.SAMPLES)))) / fp.SAMPLES


def test_weights_count(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        a, b = {}, {}
        for t in range(12):
            a[t], b[t] = rng.choice([1, 2, 9, 40]), rng.choice([1, 3, 9, 60])
        rows += [(i, 0, 1000 * i + t, w) for t, w in a.items()] + [(i, 1, 1000 * i + t, w) for t, w in b.items()]
    df = spark.createDataFrame(rows, "i long, side int, t long, w int").selectExpr("i", "side", "xxhash64(t) as t", "w")
    sig = {}
    for r in fp.samples(df, ["i", "side"]).orderBy("g").collect():
        sig.setdefault((r.i, r.side), []).extend(r.m)
    assert {len(x) for x in sig.values()} == {fp.SAMPLES}
    hit = true = 0
    for i in range(400):
        hit += sum(x == y for x, y in zip(sig[i, 0], sig[i, 1])) / fp.SAMPLES / 400
        w = [{t: x for j, s, t, x in rows[i * 24 : i * 24 + 24] if s == side} for side in (0, 1)]
        true += sum(min(w[0][t], w[1][t]) for t in w[0]) / sum(max(w[0][t], w[1][t]) for t in w[0]) / 400
    assert abs(hit - true) < 0.02


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(5, "only one of its kind is here, alas")], "doc_id long, text string")
    r = fp.with_edited(df).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and fp.with_edited(df.limit(0)).count() == 0


def test_samples_are_independent(spark):
    """The estimate's variance is that of SAMPLES independent draws."""
    rows = [(i, side, i * 100 + t) for i in range(600) for side in (0, 1) for t in range(30) if t % 3 != side]
    df = spark.createDataFrame(rows, "i long, side int, t long").selectExpr("i", "side", "xxhash64(t) as t", "1 as w")
    sig = {}
    for r in fp.samples(df, ["i", "side"]).orderBy("g").collect():
        sig.setdefault((r.i, r.side), []).extend(r.m)
    same = [sum(x == y for x, y in zip(sig[i, 0], sig[i, 1])) / fp.SAMPLES for i in range(600)]
    mean = sum(same) / 600
    assert abs(mean - 1 / 3) < 0.02
    assert sum((x - 1 / 3) ** 2 for x in same) / 600 < 1.25 * (1 / 3) * (2 / 3) / fp.SAMPLES


def test_ranges_stay_small(spark):
    """Neither an odd id nor one that many rows have (or lack) makes a large range; ranges follow the order."""
    ids = [*range(20_000), *[10**15], *[7] * 10_000, *[None] * 10_000]
    df = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    got = df.select("doc_id", F.xxhash64("text").alias("h"), fp.ranges(df).alias("b")).collect()
    order = [r.b for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    assert order == sorted(order) and max(Counter(order).values()) < 6 * fp.BUCKET_ROWS


def test_carried_columns_are_not_drawn_for(spark):
    """Of a text of one shingle and four carried columns, only the shingle has a row for each group of samples."""
    n = 500
    df = spark.range(n).selectExpr("id as k", "concat('a text of five words', id % 7) as t", "id as p", "-id as q", "cast(null as long) as r", "7L as s")
    rows, most = most_rows(fp.fingerprint(df, ["k"], ["t"], ("p", "q", "r", "s")))
    assert most <= n * (fp.SAMPLES // fp.PER_ROW + 4) and len({tuple(r.sig0) for r in rows}) == 7
    assert all((r.p, r.q, r.r, r.s) == (r.k, -r.k, None, 7) for r in rows)
