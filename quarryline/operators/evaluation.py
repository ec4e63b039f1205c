"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(hits: DataFrame, truth: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """hits(query_id, doc, rank), truth(query_id, doc), queries(query_id) -> one row: recall at each cutoff (is an
    accepted document among the first k), mrr, ndcg10, missed, n."""
    good = hits.join(truth.distinct(), ["query_id", "doc"])
    gain = F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = good.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = truth.distinct().groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(10)).cast("int").alias("k"))
    ideal = ideal.withColumn("idcg", F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)))
    q = queries.select("query_id").join(per, "query_id", "left").join(ideal, "query_id", "left")
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return q.agg(*[F.round(hit(k), 6).alias(f"recall_{k}") for k in cutoffs], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))), 6).alias("ndcg10"), F.sum(F.col("first").isNull().cast("int")).alias("missed"), F.count(F.lit(1)).alias("n"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, first) of two runs -> (query_id, first_a, first_b, verdict)."""
    j = a.select("query_id", F.col("first").alias("first_a")).join(b.select("query_id", F.col("first").alias("first_b")), "query_id", "full_outer")
    lost = F.lit(1 << 30)
    d = F.coalesce("first_b", lost) - F.coalesce("first_a", lost)
    return j.withColumn("verdict", F.when(d < 0, "better").when(d > 0, "worse").otherwise("same"))
