from fractions import Fraction

from quarryline.llm import mixing

PARTS, DEFAULT, ROWS = {"a": 5, "b": 2}, 1, 3


def fluid(blocks, parts):
    """Share of each source after each slot, sources that are out leaving theirs to the rest."""
    left, got, out = {s: Fraction(n) for s, n in blocks.items()}, {s: Fraction(0) for s in blocks}, []
    for _ in range(sum(blocks.values())):
        time = Fraction(1)
        while time > 0 and any(left.values()):
            live = [s for s in left if left[s] > 0]
            total = sum(parts[s] for s in live)
            step = min([time] + [left[s] * total / parts[s] for s in live])
            for s in live:
                left[s] -= step * parts[s] / total
                got[s] += step * parts[s] / total
            time -= step
        out.append(dict(got))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, key string, e string")
    got = mixing.mix_order(df, PARTS, DEFAULT, ROWS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.key or "") for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "", r[2] or "") for r in rows)
    assert len({r.mix_position for r in got}) == len(rows)
    n = {}
    for r in rows:
        n[r[1]] = n.get(r[1], 0) + 1
    blocks = {s: -(-v // ROWS) for s, v in n.items()}
    order = sorted({(r.mix_slot, r.source, r.mix_block) for r in got}, key=lambda x: x[0])
    assert [x[0] for x in order] == list(range(sum(blocks.values())))
    want, had = fluid(blocks, {s: PARTS.get(s, DEFAULT) for s in blocks}), {s: 0 for s in blocks}
    for (_, s, b), due in zip(order, want, strict=True):
        assert b == had[s]
        had[s] += 1
        for x in blocks:
            assert abs(had[x] - due[x]) < 1, (x, had, due)


def test_deviation_stays_below_one_block(spark):
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 7 == 1 else None if i % 11 == 2 else f"c{i % 4}", "x", None) for i in range(400)]
    check(spark, rows)


def test_one_source_and_ties(spark):
    check(spark, [(i // 3, "a", "x", "y") for i in range(20)] + [(None, "zz", None, None)] * 5)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix_order(df, PARTS).count() == 0
    assert mixing.mix(df, PARTS).columns == ["doc_id", "source"]


def test_mix_keeps_columns_and_order(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "t", "k") for i in range(90)], "doc_id long, source string, n string, key string")
    out = mixing.mix(df, {"s0": 4}, 1, 2)
    assert out.columns == df.columns
    want = [r.doc_id for r in mixing.mix_order(df, {"s0": 4}, 1, 2).orderBy("mix_position").collect()]
    assert [r.doc_id for r in out.collect()] == want


def test_more_than_512_sources(spark):
    check(spark, [(i, "a" if i % 2 else "b" if i % 8 == 0 else f"host{i * i % 1301}", None, None) for i in range(5000)])


def test_long_slot_table_is_joined_by_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    check(spark, [(i, "a" if i % 3 == 0 else "b" if i % 7 == 1 else None if i % 11 == 2 else f"c{i % 4}", "x", None) for i in range(400)])


def test_clashing_names(spark):
    rows = [(i, f"s{i % 3}", i, "a", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, Mix_Slot long, `__mix_key` string, `__mix_s_k` string")
    plain = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, source string")
    got = mixing.mix_order(docs, {"s0": 2}, 1, 4)
    assert got.columns == ["doc_id", "source", "__mix_key", "__mix_s_k", "mix_block", "mix_slot", "mix_position"]
    assert {r.doc_id: r.mix_slot for r in got.collect()} == {r.doc_id: r.mix_slot for r in mixing.mix_order(plain, {"s0": 2}, 1, 4).collect()}
    mixed = mixing.mix(docs, {"s0": 2}, 1, 4)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == rows
    assert [r.doc_id for r in mixed.collect()] == [r.doc_id for r in mixing.mix(plain, {"s0": 2}, 1, 4).collect()]
