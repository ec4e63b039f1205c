"""Keeping tables current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def changed(current: DataFrame, indexed: DataFrame, on: list[str]) -> DataFrame:
    """Rows of current that are not indexed as they are."""
    return current.join(indexed.select(*on).distinct(), on, "left_anti")


def stale(indexed: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    return changed(indexed, current, on)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an aggregation, so that map tasks combine and no key is gathered."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return out.select(*key, "__r.*")


def commit_plan(changes: DataFrame) -> DataFrame:
    """changes(repo, path, old_path, status, commit_ord, file_ord) -> (repo, path, action): the last change of a path
    wins; a rename deletes the old path and then adds the new one."""
    each = F.when(F.col("status") == "R", F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("action"), F.lit(0).alias("sub")), F.struct("path", F.lit("upsert").alias("action"), F.lit(1).alias("sub")))).otherwise(F.array(F.struct("path", F.when(F.col("status") == "D", "delete").otherwise("upsert").alias("action"), F.lit(0).alias("sub"))))
    flat = changes.select("repo", "commit_ord", "file_ord", F.explode(each).alias("e")).select("repo", "e.path", "e.action", "commit_ord", "file_ord", "e.sub")
    bad = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    return latest(flat.where(~bad), ["repo", "path"], ["commit_ord", "file_ord", "sub"]).select("repo", "path", "action")


def pending_jobs(jobs: DataFrame) -> DataFrame:
    """jobs(id, repo_id, force), pending -> one per repository: the oldest, forced if any is."""
    return jobs.groupBy("repo_id").agg(F.min("id").alias("id"), F.bool_or("force").alias("force"), F.count(F.lit(1)).alias("merged"))


def claimable(status: Column, expires: Column, now: Column) -> Column:
    return (status != "indexing") | (expires < now)


def apply_resolutions(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """edges(edge_id, dst_id, confidence, ...), resolved(edge_id, dst_id, confidence), one per edge -> edges with the new values."""
    new = resolved.select("edge_id", F.col("dst_id").alias("__d"), F.col("confidence").alias("__c"))
    out = edges.join(new, "edge_id", "left").withColumn("dst_id", F.coalesce("__d", "dst_id")).withColumn("confidence", F.coalesce("__c", "confidence"))
    return out.select(*edges.columns)


def unresolve_deleted(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges that pointed to deleted(unit_id) point nowhere (0) and keep their confidence."""
    gone = deleted.select(F.col("unit_id").alias("dst_id"), F.lit(True).alias("__gone")).distinct()
    return edges.join(gone, "dst_id", "left").withColumn("dst_id", F.when(F.col("__gone"), F.lit(0).cast(edges.schema["dst_id"].dataType)).otherwise(F.col("dst_id"))).select(*edges.columns)


def runtime_edges(calls: DataFrame, services: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """calls(client, server, calls), services(name, service_id): (resolved edges, names without a service)."""
    by = services.select(key(F.col("name")).alias("k"), "service_id")
    a, b = by.toDF("ck", "client_id"), by.toDF("sk", "server_id")
    c = calls.withColumn("ck", key(F.col("client"))).withColumn("sk", key(F.col("server")))
    edges = c.join(a, "ck").join(b, "sk").groupBy("client_id", "server_id").agg(F.sum("calls").alias("calls"))
    names = c.select(F.col("client").alias("name"), F.col("ck").alias("k")).union(c.select("server", "sk")).distinct()
    return edges, names.join(by, "k", "left_anti").select("name").distinct()


def contiguous(commits: DataFrame) -> DataFrame:
    """commits(repo, ord) -> (repo, applied, first_gap): how far each repository's commits go without a gap, and the
    first number missing before a later one, if any. Counts, not folds: ord minus its rank is constant until a gap."""
    lag = F.col("ord") - F.row_number().over(W.partitionBy("repo").orderBy("ord")) + 1
    base = F.min("ord").over(W.partitionBy("repo"))
    c = commits.select("repo", "ord").distinct().withColumn("whole", lag == base)
    return c.groupBy("repo").agg(F.max(F.when(F.col("whole"), F.col("ord"))).alias("applied"), F.when(F.bool_or(~F.col("whole")), F.max(F.when(F.col("whole"), F.col("ord"))) + 1).alias("first_gap"))


def match_repo(hints: DataFrame, repos: DataFrame, norm) -> DataFrame:
    """hints(hint_id, ref), repos(repo_id, name, url) -> (hint_id, repo_id, tier): equal normalised URL, equal name, equal last part of the URL."""
    r = repos.select("repo_id", norm(F.col("url")).alias("u"), "name", F.substring_index(norm(F.col("url")), "/", -1).alias("tail"))
    h = hints.withColumn("n", norm(F.col("ref"))).withColumn("t", F.substring_index(F.col("n"), "/", -1))
    parts = [h.join(r, F.col("n") == F.col("u")).select("hint_id", "repo_id", F.lit(0).alias("tier")), h.join(r, F.col("ref") == F.col("name")).select("hint_id", "repo_id", F.lit(1).alias("tier")), h.join(r, F.col("t") == F.col("tail")).select("hint_id", "repo_id", F.lit(2).alias("tier"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("hint_id").agg(F.min(F.struct("tier", "repo_id")).alias("m")).select("hint_id", "m.repo_id", "m.tier")
