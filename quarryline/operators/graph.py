"""Graph operators over edges (G1-G3, A1-A3, A7, A11, W3; of G4 the walk, over hops that are given)."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


_folders: set[str] = set()


def _forget(spark, folder: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by now; the folder then stays
        pass


def _cut(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared checkpoint folder, so that loops don't grow lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = (root or "file:///tmp/checkpoints").rstrip("/")  # one machine, as in tests
    folder = f"{root}/quarryline-graph-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(src, dst, ...), nodes(node), distinct -> rows (node, direction, far, ...) of edges out of and into them."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.lit("out").alias("direction"), F.col("dst").alias("far"), *rest)
    into = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.lit("in").alias("direction"), F.col("src").alias("far"), *rest)
    return out.unionByName(into)


def distances(edges: DataFrame, start: DataFrame, depth: int = 10, directed: bool = True) -> DataFrame:
    """edges(src, dst), start(node) -> (node, distance): breadth first, each node once. A frontier per step, joined
    to the edges and rid of nodes seen; it stops when a frontier is empty."""
    links = edges.select("src", "dst")
    links = _cut((links if directed else links.union(edges.select("dst", "src"))).distinct())  # read at every step
    frontier = _cut(start.select("node").distinct().withColumn("distance", F.lit(0)))
    seen = frontier  # a table for each distance
    for d in range(1, depth + 1):
        step = links.join(frontier, links["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, source, target, depth: int = 10, reverse_only: str = "implements_rpc") -> DataFrame:
    """(step, node) of a shortest path from source to target, of equals the one with the least nodes from the end
    back; empty if there is none within depth. edges(src, dst, kind): the given kind is walked backwards only."""
    links = edges.select(F.when(F.col("kind") == reverse_only, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("kind") == reverse_only, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()
    spark = edges.sparkSession
    schema = "node " + dict(edges.dtypes)["src"]
    reach = distances(links, spark.createDataFrame([(source,)], schema), depth)
    end = reach.where(F.col("node") == target).first()
    path = []
    while end is not None:  # at most depth steps back
        path.append((end["distance"], end["node"]))
        if end["distance"] == 0:
            break
        before = links.where(F.col("dst") == end["node"]).select(F.col("src").alias("node")).join(reach.where(F.col("distance") == end["distance"] - 1), "node").orderBy("node")
        end = before.first()
    return spark.createDataFrame(path[::-1], "step int, " + schema)


def expand(edges: DataFrame, start: DataFrame, hops: int = 2, cap: int = 24) -> DataFrame:
    """start(node), distinct -> (node, far, distance): what lies within the hops of each, nearest first, then least; cap each."""
    links = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("a", "b")
    seen = start.select("node", F.col("node").alias("far"), F.lit(0).alias("distance"))
    front = seen
    for d in range(1, max(1, min(hops, 3)) + 1):
        step = front.join(links, front["far"] == links["a"]).select("node", F.col("b").alias("far")).distinct().join(seen.select("node", "far"), ["node", "far"], "left_anti").withColumn("distance", F.lit(d))
        front = _cut(step)
        seen = seen.unionByName(front)
        # Who has cap already needs nothing farther.
        full = seen.where("distance > 0").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select("node")
        front = front.join(full, "node", "left_anti")
    rank = F.row_number().over(W.partitionBy("node").orderBy("distance", "far"))
    return seen.where("distance > 0").withColumn("__n", rank).where(F.col("__n") <= cap).drop("__n")


def trace(edges: DataFrame, start: DataFrame, depth: int = 16, per_level: int = 64) -> DataFrame:
    """Parameter flow. edges(src, dst, passed: array<struct<from, to>>, factor: 1 if the value must be passed by name,
    less where it may go on under its own name), start(node, name) -> (path: array<struct<node, name>>, confidence) of all chains
    that cannot go on, best first. A node is not entered twice with the same name; per_level chains go on per step."""
    chains = start.select(F.array(F.struct("node", "name")).alias("path"), F.lit(1.0).alias("confidence"))
    ended = None
    for _ in range(depth):
        tip = F.element_at("path", -1)
        step = chains.withColumn("id", F.xxhash64("path")).withColumn("at", tip["node"]).withColumn("carried", tip["name"]).join(edges, F.col("at") == F.col("src"), "left")
        to = F.get(F.filter("passed", lambda p: p["from"] == F.col("carried")), F.lit(0))["to"]
        name = F.coalesce(to, F.when(F.col("factor") < 1, F.col("carried")))
        step = step.withColumn("__to", F.struct(F.col("dst").alias("node"), name.alias("name"))).withColumn("confidence", F.col("confidence") * F.when(to.isNotNull(), 1.0).otherwise(F.coalesce("factor", F.lit(1.0))))
        step = step.withColumn("ok", F.col("dst").isNotNull() & name.isNotNull() & ~F.coalesce(F.array_contains("path", F.col("__to")), F.lit(False)))
        going = step.where("ok").select(F.concat("path", F.array("__to")).alias("path"), "confidence")
        stuck = step.groupBy("id").agg(F.first("path").alias("path"), F.max(F.col("ok").cast("int")).alias("any"), F.max("confidence").alias("c")).where("any = 0").select("path")
        stuck = stuck.join(chains, "path").select("path", "confidence")
        ended = _cut(stuck if ended is None else ended.unionByName(stuck))
        chains = _cut(going.orderBy(F.desc("confidence"), F.col("path").cast("string")).limit(per_level))
        if chains.isEmpty():
            break
    return ended.unionByName(chains).orderBy(F.desc(F.size("path")), F.desc("confidence"), F.col("path").cast("string"))


def service_links(edges: DataFrame) -> DataFrame:
    """edges(src_repo, src_service, dst_repo, dst_service, kind, via, confidence) -> one row per link, links within a service left out."""
    return edges.where("src_repo <> dst_repo or src_service <> dst_service").groupBy("src_repo", "src_service", "dst_repo", "dst_service", "kind", "via").agg(F.count(F.lit(1)).alias("links"), F.max("confidence").alias("confidence"))


def topic_map(uses: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """uses(topic, role: produces|consumes, service) -> (topic, producers, consumers, declared): sorted distinct services."""
    who = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("service"))))
    out = uses.groupBy("topic").agg(who("produces").alias("producers"), who("consumes").alias("consumers"))
    if declared is None:
        return out.withColumn("declared", F.lit(False))
    out = out.join(declared.select("topic").distinct().withColumn("declared", F.lit(True)), "topic", "full_outer")
    none = F.expr("cast(array() as array<string>)")
    return out.select("topic", F.coalesce("producers", none).alias("producers"), F.coalesce("consumers", none).alias("consumers"), F.coalesce("declared", F.lit(False)).alias("declared"))


def coverage(counts: DataFrame, kinds: list[str]) -> DataFrame:
    """counts(kind, candidates, edges) -> a row per kind, asked for or not found, and 'total'; ratio is 1 without candidates."""
    dim = counts.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    sums = dim.join(counts, "kind", "left").rollup("kind").agg(F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    return sums.select(F.coalesce("kind", F.lit("total")).alias("kind"), "candidates", "edges", F.when(F.col("candidates") <= 0, 1.0).otherwise(F.round(F.col("edges") / F.col("candidates"), 6)).alias("ratio"))


def round_robin(rows: DataFrame, group: str, group_order: list[Column], order: list[Column], limit: int) -> DataFrame:
    """The first limit rows, taken one per group and round."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("round", turn).orderBy("round", *group_order).limit(limit)


def mermaid(links: DataFrame) -> DataFrame:
    """links(src, dst, label) -> one row: the map as Mermaid text. The map of services is small by nature: its lines
    are put in order and joined in one row."""
    line = F.format_string("  %s -->|%s| %s", "src", "label", "dst")
    return links.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "label", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))


def unique_names(services: DataFrame, path: str, depth: int = 4) -> DataFrame:
    """services(name, path): names that several have get two to depth trailing parts of the path, as few as tell them apart."""
    out = services.withColumn("unique_name", F.col("name"))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    for k in range(2, depth + 1):
        many = F.count(F.lit(1)).over(W.partitionBy("unique_name")) > 1
        longer = F.array_join(F.slice(parts, -F.least(F.lit(k), F.size(parts)), F.lit(k)), "/")
        out = out.withColumn("unique_name", F.when(many & (F.size(parts) > 0), longer).otherwise(F.col("unique_name")))
    return out
