"""The link pass (G8): units and edges of all repositories to links between services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.idents import word_components
from ..operators import graph, resolve


def service_edges(found: DataFrame, services: DataFrame) -> DataFrame:
    """Rows of extract() and services(repo_id, root, name) -> (src_repo, src_service, dst_repo, dst_service, kind, via, confidence)."""
    units, edges = found.where("record = 'unit'"), found.where("record = 'edge'")
    roots = services.select(F.col("repo_id").alias("repo"), "root", F.col("name").alias("service"))
    place = lambda df: resolve.longest_prefix(df.select("*", F.col("repo_id").alias("repo"), F.col("file_path").alias("path")), roots).drop("path")
    e = place(edges).withColumn("id", F.xxhash64("repo_id", "file_path", "kind", "qualified", "start_line", "src_name"))
    u = place(units).withColumn("id", F.xxhash64("repo_id", "file_path", "kind", "qualified", "start_line"))

    calls = e.where("kind = 'http_call'").select(F.col("id").alias("call_id"), "repo", keys.parse_http(F.col("qualified"))["method"].alias("method"), keys.parse_http(F.col("qualified"))["path"].alias("path"))
    routes = u.where("kind = 'http_route'").select(F.col("id").alias("route_id"), F.col("repo").alias("route_repo"), keys.parse_http(F.col("qualified"))["method"].alias("route_method"), keys.parse_http(F.col("qualified"))["path"].alias("route_path"))
    http = resolve.match_routes(calls, routes).select(F.col("call_id").alias("edge"), F.col("route_id").alias("unit"), F.col("score").alias("factor"))

    side = lambda c: keys.parse_grpc(F.col(c))
    rpc = e.where("kind = 'rpc_call'").select(F.col("id").alias("call_id"), side("qualified")["service"].alias("service"), side("qualified")["method"].alias("method"))
    declared = u.where("kind = 'rpc_method'").select(F.col("id").alias("method_id"), side("qualified")["service"].alias("impl_service"), side("qualified")["method"].alias("method"))
    impl = e.where("kind = 'implements_rpc'").select(F.col("id").alias("impl_id"), side("qualified")["service"].alias("impl_service"), side("qualified")["method"].alias("method"))
    # Methods of an implementing class count if some proto declares them.
    known = declared.select(F.element_at(F.split("impl_service", r"\."), -1).alias("impl_service"), "method").distinct()
    impl = impl.join(known, ["impl_service", "method"], "left_semi")
    rpc = resolve.match_rpc(rpc, impl).select(F.col("call_id").alias("edge"), F.col("impl_id").alias("unit"), F.col("confidence").alias("factor"))

    where = u.select("id", "repo", "service").union(e.where("kind = 'implements_rpc'").select("id", "repo", "service")).select(F.col("id").alias("unit"), F.col("repo").alias("dst_repo"), F.col("service").alias("dst_service"))
    direct = http.union(rpc).join(e.withColumnRenamed("id", "edge"), "edge").join(where, "unit")
    direct = direct.select(F.col("repo").alias("src_repo"), F.col("service").alias("src_service"), "dst_repo", "dst_service", "kind", keys.canonical_via(F.col("qualified")).alias("via"), (F.col("confidence") * F.col("factor")).alias("confidence"))

    refs = e.where("kind in ('produces', 'consumes')").withColumn("ref", keys.parse_topic_ref(F.col("qualified")))
    config = u.where("kind = 'config_key'").select(F.col("id").alias("key_id"), F.col("repo").alias("key_repo"), word_components(F.col("name")).alias("path"), F.col("detail").alias("value"))
    hit = resolve.match_config(refs.where("ref <> ''").select(F.col("id").alias("ref_id"), "repo", word_components(F.col("ref")).alias("ref")), config.drop("value"))
    known = hit.join(config.select("key_id", "value"), "key_id").select(F.col("ref_id").alias("id"), keys.topic_key(F.col("value")).alias("__topic"))
    uses = refs.join(known, "id", "left").select("kind", "repo", "service", "confidence", F.coalesce("__topic", "qualified").alias("topic"))
    who = F.struct("repo", "service")
    flow = resolve.flows(uses.where("kind = 'produces'").select("topic", who.alias("src"), F.col("confidence").alias("conf")), uses.where("kind = 'consumes'").select("topic", who.alias("dst"), F.col("confidence").alias("conf")))
    flow = flow.select(F.col("src.repo").alias("src_repo"), F.col("src.service").alias("src_service"), F.col("dst.repo").alias("dst_repo"), F.col("dst.service").alias("dst_service"), F.lit("kafka_flow").alias("kind"), F.col("topic").alias("via"), "confidence")
    return direct.unionByName(flow)


def link(files: DataFrame, found: DataFrame, services: DataFrame) -> DataFrame:
    """Links between services, counted and with the best confidence."""
    return graph.service_links(service_edges(found, services))
