import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import simhash

SCHEMA = "doc_id long, text string, fp string, key string"


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for sep in "\t\n\x0b\f\r":
        low = low.replace(sep, " ")
    w = [x for x in low.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least(ids, fps):
    """Components by brute force."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(fps))]


def texts():
    rng = random.Random(8)
    vocab = ["Wörd%d" % i for i in range(80)] + ["THE", "of"]
    out = [None, "", " \n", "one", "One two", "a b c", "a b c a b c a b c", "\xa0 nbsp\x85x"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(80, 200))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randint(0, 99)
            out.append(" ".join(copy))
    return out


def test_equals_brute_force(spark):
    rows = [(i * 3 + 5, t, "clash", "clash") for i, t in enumerate(texts())]
    rows += [(None, rows[30][1], "", ""), (None, "no id has this text at all", "", ""), rows[9], (rows[9][0], "same id, other text", "", "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    fps = [brute(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], ["%016x" % f for f in fps], least([r[0] for r in rows], fps)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, "%016x" % (r.fp % 2**64), r.component_id)) for r in got)
    assert len({w[2] for w in want}) < len(rows) - 20


def test_hot_keys_take_the_exact_way(spark, monkeypatch):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = list({centre ^ (sum(1 << rng.randrange(24, 64) for _ in range(rng.randint(0, 3))) % 2**64) for _ in range(2600)})
    fps += [rng.getrandbits(64) for _ in range(200)]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    roots = {}
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    for r in simhash.components(edges).collect():
        roots[r.node] = r.root
    assert len(fps) > simhash.HOT
    want = least(signed, fps)
    got = [roots.get(f, f) for f in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_chain_keeps_all_within_two_bits():
    rng = np.random.default_rng(1)
    x = np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (500, 2))], np.uint64)
    assert np.any([simhash.chained(x, s) for s in range(8)], axis=0).all()


def test_deduplicate(spark):
    rows = [(1, "some words that are repeated here", "", ""), (2, "some words that are repeated here", "", ""), (1, "some words that are repeated here", "", ""), (3, "wholly different content in this row", "", ""), (None, "wholly different content in this row", "", ""), (None, "null id on its own with text", "", ""), (None, "null id on its own with text", "", "")]
    got = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "fp", "key"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "null id on its own with text"), (1, rows[0][1]), (3, rows[3][1])]
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spark_and_library_hash_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("abc é"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("abc é".encode(), 42)
