import math
import random

from quarryline.operators import fusion

from .test_hot_keys import most_rows


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    norms = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return math.copysign(math.floor(abs(dot(a, b) / norms) * 1e4 + 0.5), dot(a, b)) / 1e4 + 0.0 if norms else None


def test_nearest_equal_brute_force(spark):
    """Copies, ties, null, zero and empty vectors, and unequal lengths."""
    rng = random.Random(5)
    whole = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(8)] for _ in range(60)]
    odd = [None, [], [0.0] * 8, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]]
    rows = [(f"d{i:03}", rng.choice(whole if i % 20 else odd)) for i in range(400)]
    asked = [(i, v) for i, v in enumerate(rng.sample(whole, 12) + odd)]
    vectors = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    got = {}
    for r in fusion.nearest(vectors, "id", "v", spark.createDataFrame(asked, "query_id int, q array<float>"), 7, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc, r.score)
    for i, q in asked:
        all_ = [(s, d) for d, v in rows for s in [cosine(v, q)]]
        want = sorted(all_, key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))[:7]
        assert [got[i][n] for n in range(1, 8)] == [(d, s) for s, d in want], i
    none = spark.createDataFrame([], "query_id int, q array<float>")
    assert fusion.nearest(vectors, "id", "v", none, 7).count() == 0
    assert fusion.nearest(vectors.limit(0), "id", "v", spark.createDataFrame(asked[:2], none.schema), 7).count() == 0


def test_nearest_makes_no_row_for_each_pair(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1000)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id % 2 = 0").selectExpr("id query_id", "v q")
    found, most = most_rows(fusion.nearest(vectors, "id", "v", queries, 1))
    assert len(found) == 500 and all(r.score == 1.0 for r in found) and most <= 20000
