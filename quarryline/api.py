"""The engine as one object: a method per question, each giving a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import idents, predicates
from .operators import chunks, fusion, graph, incremental, keyword, promote

MAX_LIMIT, DEFAULT_LIMIT = 100, 10


class BadRequest(ValueError):
    pass


@dataclass
class Engine:
    """files(repo_id, path, language, content), units(unit_id, repo_id, file_path, kind, name, qualified, start_line,
    end_line), edges(edge_id, src_id, dst_id, kind, dst_name, repo_id, file_path, line, confidence), repos(id, active)."""

    files: DataFrame
    units: DataFrame
    edges: DataFrame
    repos: DataFrame

    def search(self, query: str, limit: int = DEFAULT_LIMIT, repos: list[str] | None = None, languages: list[str] | None = None, lines: int = 60, overlap: int = 10) -> DataFrame:
        """Windows of lines ranked by BM25 over their text and, as a second field, their path; overlapping ones merged."""
        if not query.strip():
            raise BadRequest("empty query")
        limit = min(max(limit, 1), MAX_LIMIT)
        files = predicates.in_working_set(self.files, self.repos, "repo_id", repos).where(predicates.matches(within={"language": languages or []}))
        w = chunks.line_windows(files, ["repo_id", "path"], "content", lines, overlap).withColumn("doc", F.xxhash64("repo_id", "path", "ordinal"))
        spark = self.files.sparkSession
        text = F.coalesce(promote.callee(F.lit(query)), F.lit(query))
        q = spark.range(1).select(F.lit("q").alias("query_id"), text.alias("t"))
        terms = lambda tokens: q.select("query_id", F.explode(tokens(F.col("t"))).alias("term")).distinct()
        both = keyword.scores(w, "doc", keyword.standard_tokens(F.col("chunk")), terms(keyword.standard_tokens)).unionByName(keyword.scores(w, "doc", keyword.code_tokens(F.col("path")), terms(keyword.code_tokens)))
        top = keyword.top_k(both.groupBy("query_id", "doc").agg(F.sum("score").alias("score")), max(limit, 50))
        hits = top.join(w.select("doc", "repo_id", "path", "start_line", "end_line"), "doc")
        return fusion.merge_spans(hits, ["repo_id", "path"]).orderBy("rank").limit(limit)

    def symbol(self, name: str, limit: int = 50) -> DataFrame:
        """Units by name: the exact ones that aren't tests or generated, then others that contain it, shorter names first."""
        if not name:
            raise BadRequest("a selector is required")
        u = predicates.in_working_set(self.units, self.repos).where(predicates.matches(contains_fold=(("name",), name)))
        penalty, exact = predicates.is_penalty_path(F.col("file_path")), F.lower("name") == name.lower()
        return u.orderBy(F.when(exact & ~penalty, 0).otherwise(1), penalty, ~exact, F.length("name"), "repo_id", "file_path", "start_line", "kind", "name", "unit_id").limit(min(limit, 500))

    def definition(self, repo: str, path: str, line: int) -> DataFrame:
        """The innermost unit around a line."""
        cond = predicates.matches(eq={"repo_id": repo, "file_path": path}, line=("start_line", "end_line", line))
        return self.units.where(cond).orderBy(F.desc("start_line"), "end_line").limit(1)

    def references(self, unit_id: int, limit: int = 50) -> DataFrame:
        """Resolved edges to a unit, then unresolved ones of its name in its repository."""
        u = self.units.where(F.col("unit_id") == unit_id).select("unit_id", F.col("repo_id").alias("__r"), F.col("name").alias("__n"))
        own = self.edges.join(u, F.col("dst_id") == F.col("unit_id"), "left_semi").withColumn("tier", F.lit(0))
        rest = self.edges.where("dst_id = 0").join(u, (F.col("repo_id") == F.col("__r")) & (idents.last_component(F.col("dst_name")) == F.col("__n")), "left_semi").withColumn("tier", F.lit(1))
        return own.unionByName(rest).orderBy("tier", "file_path", "line", "kind", "edge_id").limit(min(limit, 500))

    def _links(self) -> DataFrame:
        return self.edges.where("dst_id <> 0").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind")

    def neighbors(self, ids: list[int]) -> DataFrame:
        return graph.neighbors(self._links(), self.files.sparkSession.createDataFrame([(i,) for i in ids], "node long"))

    def path(self, source: int, target: int) -> DataFrame:
        return graph.shortest_path(self._links(), source, target)

    def context(self, query: str, limit: int = 5, hops: int = 1) -> DataFrame:
        """The units that the best hits fall into, once each, with what lies around them in the graph."""
        hits = self.search(query, limit=min(limit, 20) * 4).select("repo_id", F.col("path").alias("file_path"), F.col("rank").alias("lid"), F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
        spans = self.units.select("repo_id", "file_path", "unit_id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
        units = chunks.best_overlap(hits, spans, ["repo_id", "file_path"], [F.desc("r_start"), F.col("unit_id")]).where("unit_id is not null")
        items = units.groupBy("unit_id").agg(F.min("lid").alias("rank")).orderBy("rank").limit(limit)
        near = graph.expand(self._links(), items.select(F.col("unit_id").alias("node")), hops)
        related = near.groupBy(F.col("node").alias("unit_id")).agg(F.array_sort(F.collect_list(F.struct("distance", "far"))).alias("related"))
        return items.join(related, "unit_id", "left").orderBy("rank")

    def stats(self) -> DataFrame:
        return self.files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("content")).alias("size"))

    def apply_commits(self, changes: DataFrame) -> DataFrame:
        return incremental.commit_plan(changes)
