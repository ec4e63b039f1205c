"""Keys that everyone has: results as by brute force, and no plan that makes a row for each pair."""

import random

from quarryline.operators import resolve
from quarryline.plans import catalogue


def most_rows(df):
    """The rows of a frame and the most that a node of its plan made."""
    rows = df.collect()

    def nodes(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from nodes(plan.executedPlan())
            return
        if name.endswith("QueryStageExec"):
            yield from nodes(plan.plan())
            return
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    made = [m.get().value() for n in nodes(df._jdf.queryExecution().executedPlan()) if (m := n.metrics().get("numOutputRows")).isDefined()]
    assert made
    return rows, max(made)


def ends(seq, suffix):
    return bool(suffix) and seq is not None and len(suffix) <= len(seq) and seq[len(seq) - len(suffix) :] == suffix


EDGE, UNIT = "edge_id long, repo string, file string, name string, receiver array<string>", "unit_id long, repo string, unit_file string, name string, owner array<string>, pos int"


def test_local_calls_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab")
    words = lambda n: rng.choice([None, *[[word() for _ in range(rng.randint(0, n))] for _ in range(6)]])
    edges = [(i // 2 if i > 290 else i, rng.choice(["r", "s", None]), rng.choice(["f", "g", None]), rng.choice("xyz"), words(2)) for i in range(300)]
    units = [(i, rng.choice(["r", "r", "s", "t", None]), rng.choice(["f", "g", "h", None]), rng.choice("xy" if i % 9 else "z"), words(3), rng.choice([1, 2, 3])) for i in range(30)]
    got = resolve.resolve_local(spark.createDataFrame(edges, EDGE), spark.createDataFrame(units, UNIT)).collect()
    meets = {}
    for e, repo, file, name, receiver in edges:
        for u, of, unit_file, unit_name, owner, pos in units:
            if repo is not None and (repo, name) == (of, unit_name):
                owned, same = ends(owner, receiver), file is not None and file == unit_file
                meets.setdefault(e, []).append(((0 if same else 1) if owned else 2 if same else 3, pos, u, owned))
    want = {}
    for e, c in meets.items():
        tier, _, u, _ = min(c)
        n_owned = sum(x[3] for x in c)
        want[e] = (u, tier, {0: 0.95, 1: 0.8 if n_owned == 1 else 0.7, 2: 0.95, 3: 0.8 if len(c) == 1 else 0.7}[tier])
    assert len(got) == len(want) and {r.edge_id: (r.unit_id, r.tier, r.factor) for r in got} == want
    assert {t for _, t, _ in want.values()} == {0, 1, 2, 3}


def test_local_calls_of_one_name(spark):
    n = 3000
    edges = spark.createDataFrame([(i, "r", f"f{i % 7}", "x", ["o"] if i % 2 else []) for i in range(n)], EDGE)
    units = spark.createDataFrame([(i, "r", f"f{i % 5}", "x", ["p", "o"], 1) for i in range(n)], UNIT)
    rows, most = most_rows(resolve.resolve_local(edges, units))
    assert len(rows) == n and most <= 3 * n


REF, KEY = "ref_id long, repo string, ref array<string>", "key_id long, key_repo string, path array<string>"


def test_config_keys_equal_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: rng.choice([None, *[[rng.choice("abc") for _ in range(rng.randint(0, n))] for _ in range(8)]])
    refs = [(i // 2 if i > 390 else i, rng.choice(["r", "s", None]), words(4)) for i in range(400)]
    keys = [(i, rng.choice(["r", "s", "t", None]), words(3)) for i in range(25)]
    got = resolve.match_config(spark.createDataFrame(refs, REF), spark.createDataFrame(keys, KEY)).collect()
    meets = {}
    for r, repo, ref in refs:
        for k, of, path in keys:
            tier = 2 if ends(path, ref) else 1 if len(path or []) >= 2 and ends(ref, path) else 0
            if tier:
                meets.setdefault(r, []).append((0 if repo is None or of is None else -2 * tier - (repo == of), k, tier))
    want = {r: min(c)[1:] for r, c in meets.items()}
    assert len(got) == len(want) and {r.ref_id: (r.key_id, r.tier) for r in got} == want
    assert {t for _, t in want.values()} == {1, 2}


def test_config_keys_of_one_leaf(spark):
    n = 3000
    refs = spark.createDataFrame([(i, f"r{i % 3}", ["host"] if i % 2 else ["a", "db", "host"]) for i in range(n)], REF)
    keys = spark.createDataFrame([(i, f"r{i % 4}", ["db", "host"]) for i in range(n)], KEY)
    rows, most = most_rows(resolve.match_config(refs, keys))
    assert len(rows) == n and most <= 5 * n


def test_stale_pairs_of_one_size(spark, tmp_path):
    n = 2000
    for name, rows, schema in (
        ("nation", [(1,)], "n_nationkey int"),
        ("supplier", [(i, 1 if i % 2 else 9) for i in range(n)] + [(n, None)], "s_suppkey long, s_nationkey int"),  # no nation 9
        ("part", [(i, 1 if i % 3 else 9) for i in range(n)] + [(n, None)], "p_partkey long, p_size int"),
        ("lineitem", [(i, i) for i in range(12)] * 2 + [(n, n), (None, 1), (1, None)], "l_partkey long, l_suppkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows, most = most_rows(catalogue.stale_removed(spark, str(tmp_path)))
    want = {(i, i) for i in range(12) if not (i % 2 and i % 3)} | {(n, n), (None, 1), (1, None)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want and most <= 3 * n
