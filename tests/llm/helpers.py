import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = c.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql, sf_dir):
    """Rows of a query and of its SQL, columns by name, any order."""
    names, want = oracle(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def docs_of(spark, texts, extra=""):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
