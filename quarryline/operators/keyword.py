"""Keyword retrieval (B1-B6, A5): Okapi BM25 over an inverted index that is a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.idents import token_components
from .graph import _cut

K1, B = 1.2, 0.75
#: Cells (documents times questions) that are summed at once.
CELLS = 1 << 20


def standard_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def code_tokens(text: Column) -> Column:
    """Words of code and paths: separators and camel case cut, lower case."""
    return F.flatten(F.transform(F.filter(F.split(text, r"[\s_./-]+"), lambda x: x != ""), token_components))


def postings(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(term, doc, tf, dl). The terms of a document are counted where it is read."""
    df = docs.select(F.col(doc_id).alias("doc"), tokens.alias("__t")).select("doc", F.size("__t").alias("dl"), F.explode("__t").alias("term"))
    return df.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc", "tf", "dl")


def _found(tokens: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term in a row: the row, the term's place, how often it stands there."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique((np.repeat(np.arange(len(tokens)), lengths) * len(terms) + at)[at >= 0], return_counts=True)
    return key // len(terms), key % len(terms), tf


def _places(terms: pa.Array):
    """(doc, dl, tokens) -> (doc, dl, tokens' number, null for null ones; places of terms and how often each stands there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, dl, tokens = batch.columns
            row, at, tf = _found(tokens, terms)
            ends = pa.array(np.searchsorted(row, np.arange(len(doc) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([doc, dl, pc.list_value_length(tokens).cast(pa.int64()), *lists], ["doc", "dl", "n", "at", "tf"])

    return run


def _again(at: pa.ListArray, tf: pa.ListArray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _found gives, from its lists; a term that is listed twice in a row counts both times."""
    row = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    key, to = np.unique(row * terms + at.flatten().to_numpy(), return_inverse=True)
    return key // terms, key % terms, np.bincount(to, tf.flatten().to_numpy(), len(key)).astype(np.int64)


def _counts(terms: int):
    """(n, at, tf) -> (term, n): documents with the term at a place; at -1 all rows, at -2 those that are not null, at -3 their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, whole, length = np.zeros(terms, np.int64), 0, 0, 0
        for batch in batches:
            n, at, tf = batch.columns
            df += np.bincount(_again(at, tf, terms)[1], minlength=terms)
            rows, whole, length = rows + len(n), whole + len(n) - n.null_count, length + (pc.sum(n).as_py() or 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3, *some], pa.int64()), pa.array([rows, whole, length, *df[some]], pa.int64())], ["at", "n"])

    return run


def _sums(idf: np.ndarray, avgdl: float, starts: np.ndarray, asked: np.ndarray, ids: pa.Array, k: int | None, margin: float):
    """(doc, length, places, counts) -> (query_id, doc, score). Term i is asked by questions asked[starts[i] : starts[i + 1]]. With k, what
    can't be among a question's k best of the whole stays out: what k documents at hand exceed by more than the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                doc, dl, at, tf = batch.slice(i, step).columns
                row, term, tf = _again(at, tf, len(idf))
                dl = pc.fill_null(dl, 0).to_numpy()[row]
                part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                n = starts[term + 1] - starts[term]
                question = asked[np.repeat(starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                cells = np.bincount(np.repeat(row, n) * len(ids) + question, np.repeat(part, n), len(doc) * len(ids))
                hits = cells != 0  # a term that is found adds more than 0
                if k and k < len(doc):
                    each = cells.reshape(len(doc), len(ids))
                    hits &= (each >= np.partition(each, len(doc) - k, axis=0)[len(doc) - k] - margin).ravel()
                hit = np.flatnonzero(hits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit % len(ids))), doc.take(pa.array(hit // len(ids))), pa.array(cells[hit])], ["query_id", "doc", "score"])

    return run


def scores(docs: DataFrame, doc_id: str, tokens: Column, queries: DataFrame, boost: float = 1.0, k: int | None = None, digits: int = 4) -> DataFrame:
    """queries(query_id, term), distinct -> (query_id, doc, score). Documents that no term meets are left out; with k, also
    some that top_k of k and digits would leave out anyhow, those of equal rounded scores never.

    The questions (a user's, not a table that grows) and the statistics of their terms come to the driver at once. Each
    document is cut into tokens once, and what it has of those terms is written; from that come the statistics, and the
    scores for all questions where it is read: neither postings nor scores are shuffled. Rows of one id and length are
    one document; if there are any, what they have is put together first.
    """
    df = docs.select(F.col(doc_id).alias("doc"), tokens.alias("__t"))
    out = T.StructType([queries.schema["query_id"], df.schema["doc"], T.StructField("score", T.DoubleType())])
    pairs = queries.where("term is not null").toArrow()
    words, ids = pairs["term"].combine_chunks().dictionary_encode(), pairs["query_id"].combine_chunks().dictionary_encode("encode")
    terms, ids, term, asked = words.dictionary, ids.dictionary, words.indices.to_numpy(), ids.indices.to_numpy()
    if not len(terms):
        return df.sparkSession.createDataFrame([], out)
    lists = T.ArrayType(T.IntegerType())
    df = df.select("doc", F.size("__t").alias("dl"), "__t")
    written = T.StructType([*df.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField("at", lists), T.StructField("tf", lists)])
    df = _cut(df.mapInArrow(_places(terms), written))
    count = lambda rows: {r.at: r.n for r in rows.select("n", "at", "tf").mapInArrow(_counts(len(terms)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n = found = count(df)
    repeated = not df.groupBy("doc").count().where("count > 1").isEmpty()
    if repeated:
        of = F.collect_list(F.struct("at", "tf"))  # of one order
        df = df.groupBy("doc", "dl").agg(F.sum("n").alias("n"), of.alias("x")).select("doc", "dl", "n", F.flatten("x.at").alias("at"), F.flatten("x.tf").alias("tf"))
        found = count(df)
    by = np.array([found.get(i, 0) for i in range(len(terms))])
    idf = np.log(1 + (n.get(-1, 0) - by + 0.5) / (by + 0.5))
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    asked = asked[np.argsort(term, kind="stable")]
    scored = df.select("doc", "dl", "at", "tf").mapInArrow(_sums(idf, n.get(-3, 0) / max(1, n.get(-2, 0)), starts, asked, ids, None if repeated else k, 2 * 10.0**-digits / boost), out)
    if repeated:
        scored = scored.groupBy("query_id", "doc").agg(F.sum("score").alias("score"))
    return scored.withColumn("score", boost * F.col("score"))


def top_k(hits: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(query_id, doc, score, rank): the k best of each query by rounded score, then the least doc."""
    rounded = hits.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)
