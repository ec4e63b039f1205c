import random

import pyarrow as pa

from quarryline.llm import chat, queries

from .helpers import same

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ODD = ["", None, "<|turn|>", "<\\|end|>", "</s><s>[INST][/INST]", "<<SYS>><</SYS>>", "é\n漢字🙂", "a" * 70000, "<\\\\|text|>\\", "[\\[INST]", "x</s>"]


def test_round_trip(spark):
    rng, rows = random.Random(3), []
    for conv in [None, *range(-2, 40)]:
        rows += [(conv, k, rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice(ODD), "clash") for k in range(rng.randint(1, 9))]
    rows += rows[:3]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
        back = {r.conv_id: r for r in chat.read_chat(got).collect()}
        raw = {r.conv_id: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    convs = {r[0] for r in rows}
    assert set(back) == convs and len(raw) == len(convs)
    for conv in convs:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert list(zip(back[conv].roles, back[conv].texts)) == [t[2:] for t in turns]
        assert back[conv].loss_texts == [t[3] for t in turns if t[2] == "assistant"]
        assert back[conv].formatted_chars == len(raw[conv].formatted) and raw[conv].n_turns == len(turns)
        assert raw[conv].formatted.count("<|turn|>") == len(turns) and "</s>" not in raw[conv].formatted


def test_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    same(queries.op10_chat(spark, d), queries.SQL["op10_chat"], d)


def test_large_conversations_share_a_batch(spark, monkeypatch):
    """Conversations that are large together are put out in several batches."""
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 1, 2, 3, 3, 4], "role": ["user", "assistant"] * 3, "text": ["a" * 900, "b", "c" * 1200, "d", "e" * 50, "f"]})
    want = pa.Table.from_batches(chat._format(iter([batch])))
    monkeypatch.setattr(chat, "_BATCH_BYTES", 1000)
    parts = list(chat._format(iter([batch])))
    assert len(parts) > len(list(want.to_batches())) and pa.Table.from_batches(parts).to_pylist() == want.to_pylist() and want.num_rows == 4
