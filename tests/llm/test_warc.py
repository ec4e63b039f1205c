import hashlib

import pyarrow as pa

from quarryline.llm import queries, warc

from .helpers import same

SCHEMA = "page_id long, url string, html string, digest string, leader string"


def test_round_trip_and_revisits(spark):
    long = "<p>é" + "x" * 1200
    rows = [(i, f"http://h/{i}", long, "d", "l") for i in range(6)] + [(5, "again", long, None, None)]
    rows += [(10, None, None, None, None), (11, "u\r\nWARC-Type: x", "short", "", ""), (12, "", "short", "", ""), (None, "n", long, "", ""), (None, "n", long + "y", "", ""), (None, "n", long + "y", "", "")]
    rows += [(100 + i, "v", f"page {i} " + "lorem ipsum " * (i % 90), "", "") for i in range(400)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) == sum(m.records for m in manifest.collect())
    byte = lambda h: (h or "").encode()
    lead = {}
    for r in rows:
        if r[0] is not None and len(byte(r[2])) >= 1000:
            lead[byte(r[2])] = max(lead.get(byte(r[2]), r[0]), r[0])
    want = []
    for r in rows:
        p = byte(r[2])
        n = sum(byte(x[2]) == p for x in rows)
        revisit = n > 1 and p in lead and r[0] != lead[p]
        want.append((r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", lead[p] if revisit else None, None if revisit else p))
    assert sorted(map(str, want)) == sorted(str((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to, None if g.payload is None else bytes(g.payload))) for g in got)
    assert any(r.url == "u%0D%0AWARC-Type: x" for r in got)


def test_dictionary_leads_the_archive(spark, tmp_path):
    a = warc._Archive(f"file://{tmp_path}")
    for i in range(3000):
        a.add(warc.record(i, f"http://host/{i}", (f"<html><body>words number {i * i} and more " * 40).encode(), "0", False, None))
    a.close()
    raw = (tmp_path / a.name).read_bytes()
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    with pa.OSFile(str(tmp_path / a.name)) as f:
        assert sum(1 for _ in warc._records(f)) == 3001


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    same(queries.op7_warc(spark, d), queries.SQL["op7_warc"], d)


def test_few_records_and_long_ones(spark):
    rows = [(1, "http://h/é", None), (2, None, "漢" * 3_000_000), (3, "u", "x" * 1500)]
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))).collect()}
    assert {k: bytes(r.payload).decode() for k, r in got.items()} == {1: "", 2: rows[1][2], 3: rows[2][2]} and got[1].url == "http://h/é"
