import duckdb
import pytest

from quarryline.plans import catalogue, estate  # noqa: F401

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, D)
    rows = got.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    cur = con.execute(catalogue.SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted(cur.fetchall(), key=key)
