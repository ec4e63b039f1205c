from quarryline.streaming import watch


def test_bursts_of_a_stream_end_when_quiet(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.3"), ("a", "2024-01-01 00:00:01.0"), ("b", "2024-01-01 00:00:00.1"), ("z", "2024-01-01 00:01:00.0")]
    df = spark.createDataFrame(rows, "repo_id string, t string").selectExpr("repo_id", "cast(t as timestamp) as ts")
    df.write.parquet(f"{tmp_path}/in")
    want = sorted((r.repo_id, r.n) for r in watch.debounce(df).where("repo_id <> 'z'").collect())
    stream = watch.debounce(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert want == [("a", 1), ("a", 2), ("b", 1)] and sorted((r.repo_id, r.n) for r in spark.table("bursts").collect()) == want


def test_commits_are_taken_in_order(spark, tmp_path):
    from quarryline.streaming import commits

    schema = "repo string, sha string, parents array<string>, ord int"
    for i, rows in enumerate([[("r", "a", [], 1), ("r", "b", ["a"], 2), ("s", "x", ["w"], 1)], [("r", "b", ["a"], 3), ("r", "d", ["c"], 4), ("s", "y", ["x", "q"], 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = commits.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = sorted((r.repo, r.sha, r.verdict) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("r", "a", "accepted"), ("r", "b", "accepted"), ("r", "b", "applied"), ("r", "d", "gap"), ("s", "x", "accepted"), ("s", "y", "accepted")]
