"""Vectors, fusion, reranking, merging and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

RRF_K = 60
#: Vectors and numbers that a block has at most, and queries that are compared with a block at once.
ROWS, NUMBERS, STRIP = 4096, 1 << 18, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (ids, vectors): many rows as one."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, ROWS)
            part = part.slice(0, max(1, min(ROWS, NUMBERS * part.num_rows // max(1, len(part.column(1).flatten())))))
            at += part.num_rows
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns], ["ids", "vectors"])


def _matrices(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the places of the vectors of that length, their numbers, their norms. Length 0 has those without a cosine:
    null, empty and zero ones, and those with a null within."""
    lengths, out = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), {}
    none = [np.flatnonzero(lengths == 0)]
    for n in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == n)
        numbers = vectors.take(pa.array(places)).flatten()
        m = numbers.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        norms = np.sqrt(_sums(m, m))
        good = (norms != 0) & ~numbers.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1)
        none.append(places[~good])
        out[n] = places[good], m[good], norms[good]
    return out | {0: (np.concatenate(none), np.empty((0, 0)), np.empty(0))}


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added in order of their places, as dot() does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _nearest(k: int, digits: int):
    """Pairs of blocks (queries, vectors) -> (query_id, doc, score): each query's k best of the block, at least.

    A matrix product finds who may be among them, with a margin wider than rounding; their scores are added up anew, in
    order. Vectors without a cosine come last, those of NaN first, as Spark orders them.
    """

    def best(rank: np.ndarray, q: tuple, v: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = (q[1] @ v[1].T) / (q[2][:, None] * v[2])
        a[np.isnan(a)] = np.inf
        at = max(0, a.shape[1] - k)
        rows, cols = np.nonzero(a >= (np.partition(a, at, axis=1)[:, at] - 2 * 10.0**-digits)[:, None])
        scores = _sums(v[1][cols], q[1][rows]) / (v[2][cols] * q[2][rows])
        rounded = np.copysign(np.floor(np.abs(scores) * 10.0**digits + 0.5), scores) + 0.0
        order = np.lexsort((rank[v[0][cols]], -np.where(np.isnan(rounded), np.inf, rounded), rows))
        keep = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]  # nonzero gives rows in order
        return q[0][rows[keep]], v[0][cols[keep]], scores[keep]

    def compare(qs: pa.ListArray, ids: pa.Array, vs: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rank, vectors = pc.rank(ids, null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64), _matrices(vs)
        order = np.argsort(rank)
        for n, q in _matrices(qs).items():
            with_cosine = vectors[n][0] if n and n in vectors else np.empty(0, np.int64)
            for at in range(0, len(q[0]) if len(with_cosine) else 0, STRIP):
                with np.errstate(all="ignore"):
                    yield best(rank, tuple(x[at : at + STRIP] for x in q), vectors[n])
            if len(with_cosine) < k:
                rest = order[~np.isin(order, with_cosine)][:k]
                yield np.repeat(q[0], len(rest)), np.tile(rest, len(q[0])), np.full(len(q[0]) * len(rest), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, qs, ids, vs = (c[i].values for c in batch.columns)
                for of, docs, scores in compare(qs, ids, vs):
                    columns = [qids.take(pa.array(of)), ids.take(pa.array(docs)), pa.array(scores, pa.float64(), mask=np.isneginf(scores))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc", "score"])

    return run


def nearest(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """queries(query_id, q) -> (query_id, doc, score, rank): exact cosine neighbours of a stated set of queries.

    Both sides are put into blocks, and each block meets each: a row a pair of blocks. Each keeps the k best of each query, so
    that what is shuffled is bounded by blocks * queries * k. Pairs without a cosine (null or zero vectors, or of unequal
    lengths) score null and come last. Filters belong on vectors.
    """
    packed = lambda df, i, v: df.select(i, v).mapInArrow(_blocks, T.StructType([T.StructField("ids", T.ArrayType(df.schema[i].dataType)), T.StructField("vectors", T.ArrayType(df.schema[v].dataType))]))
    # Few rows, each of much work: dealt out, as a table may be read by one task.
    blocks = packed(vectors, vec_id, vector).repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism)
    asked = packed(queries, "query_id", "q").toDF("qids", "qs")
    pairs = blocks.crossJoin(asked).select("qids", "qs", "ids", "vectors")
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc", vectors.schema[vec_id].dataType), T.StructField("score", T.DoubleType())])
    scored = pairs.mapInArrow(_nearest(k, digits), out).withColumn("score", F.round("score", digits))
    # Spark puts a limit by query into each task before the shuffle, as only the first k ranks are asked for.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rrf(sources: list[tuple[DataFrame, float]], digits: int = 8) -> DataFrame:
    """Ranked (query_id, doc, rank) lists with weights -> (query_id, doc, fused)."""
    parts = [s.select("query_id", "doc", (F.lit(w) / (RRF_K + F.col("rank"))).alias("x")) for s, w in sources]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("query_id", "doc").agg(F.round(F.sum("x"), digits).alias("fused"))


def convex(sources: list[tuple[DataFrame, float]], digits: int = 8) -> DataFrame:
    """Scores of each list scaled to 0..1 between its floor (its least score, at most 0) and its greatest; a list whose scores tie counts 1."""
    parts = []
    for s, w in sources:
        over = W.partitionBy("query_id")
        floor, top = F.least(F.lit(0.0), F.min("score").over(over)), F.max("score").over(over)
        parts.append(s.select("query_id", "doc", F.lit(w) * F.when(top == floor, 1.0).otherwise((F.col("score") - floor) / (top - floor)), ).toDF("query_id", "doc", "x"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("query_id", "doc").agg(F.round(F.sum("x"), digits).alias("fused"))


def cluster(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits(keys, source, rank, doc, start_line, end_line, worth) -> one row per cluster: (keys, doc, start_line,
    end_line, score, sources). The keys are a question and a file.

    Hits come source by source, in rank order. Each joins the cluster that its document opened, or else the first one without
    a hit of its source whose shown hit it overlaps, or opens a cluster. A cluster shows its hit of the best rank, the first of
    equals, and its score is what its hits are worth together. What is folded is a question's hits in one file.
    """
    at = "get(filter(sequence(0, size(kept) - 1), i -> {}), 0)"
    own, near = "get(kept, i).opened = h.doc", "not array_contains(get(kept, i).sources, h.source) and get(kept, i).start_line <= h.end_line and h.start_line <= get(kept, i).end_line"
    found = f"if(size(kept) = 0, null, coalesce({at.format(own)}, {at.format(near)}))"
    new = "struct(h.doc as opened, h.doc as doc, h.start_line as start_line, h.end_line as end_line, h.rank as rank, h.worth as score, array(h.source) as sources)"
    shown = lambda c: f"if(h.rank < c.rank, h.{c}, c.{c}) as {c}"
    joined = f"struct(c.opened as opened, {shown('doc')}, {shown('start_line')}, {shown('end_line')}, least(h.rank, c.rank) as rank, c.score + h.worth as score, array_union(c.sources, array(h.source)) as sources)"
    # A one-element array binds the place, so that it's found once.
    step = f"(kept, h) -> get(transform(array({found}), p -> if(p is null, concat(kept, array({new})), transform(kept, (c, i) -> if(i = p, {joined}, c)))), 0)"
    item = F.struct("source", "rank", "doc", "start_line", "end_line", F.col("worth").cast("double").alias("worth"))
    folded = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    first = new.replace("h.", "get(all, 0).")
    folded = folded.withColumn("k", F.expr(f"aggregate(slice(all, 2, size(all)), array({first}), {step})"))
    return folded.select(*keys, F.explode("k").alias("k")).select(*keys, "k.doc", "k.start_line", "k.end_line", "k.score", "k.sources")


def rerank_blend(hits: DataFrame, top_n: int) -> DataFrame:
    """hits(query_id, doc, score, rank, model): the first top_n take, in the model's order, scores spread evenly as
    the model's are, between the greatest of the head and the greater of its least and the tail's greatest."""
    over, head = W.partitionBy("query_id"), F.col("rank") <= top_n
    hi, lo = F.max(F.when(head, F.col("score"))).over(over), F.min(F.when(head, F.col("score"))).over(over)
    lo = F.greatest(lo, F.coalesce(F.max(F.when(~head, F.col("score"))).over(over), lo))
    m_hi, m_lo = F.max(F.when(head, F.col("model"))).over(over), F.min(F.when(head, F.col("model"))).over(over)
    spread = F.when(m_hi == m_lo, F.col("score")).otherwise(lo + (hi - lo) * (F.col("model") - m_lo) / (m_hi - m_lo))
    return hits.withColumn("blended", F.when(head, spread).otherwise(F.col("score")))


def merge_spans(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits(keys, rank, start_line, end_line, score) -> the kept ones, widened: in rank order each hit is absorbed by
    the first kept hit it overlaps, or is kept. A fold over the hits of one file, in rank order."""
    item = F.struct("rank", "start_line", "end_line", "score")
    step = """(kept, h) -> if(exists(kept, k -> k.start_line <= h.end_line and h.start_line <= k.end_line),
        transform(kept, (k, i) -> if(i = array_position(transform(kept, x -> x.start_line <= h.end_line and h.start_line <= x.end_line), true) - 1,
            struct(k.rank as rank, least(k.start_line, h.start_line) as start_line, greatest(k.end_line, h.end_line) as end_line, k.score as score), k)),
        concat(kept, array(h)))"""
    folded = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("h")).withColumn("k", F.expr(f"aggregate(slice(h, 2, size(h)), slice(h, 1, 1), {step})"))
    return folded.select(*keys, F.explode("k").alias("k")).select(*keys, "k.*")


def byte_budget(rows: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each key's rows whose sizes sum to at most the budget."""
    running = F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running_bytes", running).where(F.col("running_bytes") <= budget)
