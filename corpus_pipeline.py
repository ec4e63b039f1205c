"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Rows with a null, empty or letterless text go in the first stage; of rows with one id the third keeps one; a null source
is a source of its own; other columns are kept up to the last stage, whatever their names. No documents, no rows out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import langid, mixing, queries, simhash, toxicity
from quarryline.llm.common import shared_dir, table

#: A document is rejected if no language is found, or none that is at least this likely.
MIN_LANGUAGE_SCORE = 0.5


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: Column, results: set[str]) -> DataFrame:
    """The rows of docs whose judgement meets the condition, with all their columns, those named as results included."""
    if results.isdisjoint(c.lower() for c in docs.columns):
        return judge(docs).where(condition).select(*[F.col(f"`{c}`") for c in docs.columns])
    return judge(docs.select(F.struct("*").alias("row"), "text")).where(condition).select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Null, empty and letterless texts go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    known = (F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)
    return _kept(docs, lambda d: langid.identify(d, model), known, {"lang_pred", "lang_score"})


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; without labels of both classes, all or (if all are toxic) none."""
    index = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.rate(d, index), F.col("toxicity") < toxicity.THRESHOLD, {"toxicity", "evidence"})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; equal ids are one document."""
    return simhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in mixed order."""
    return mixing.mix(docs, queries.PARTS, queries.DEFAULT_PARTS, queries.BLOCK_ROWS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come in the order of docs' part files, which is the mixed order.

    Spark packs files into read partitions by size. So rows go back to the partition of their part's number, in the
    order of the file. A frame that isn't read from files has its rows in order already, and encoding keeps that.
    """
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return queries.encoded(docs)
    parts = [int(m[1]) for f in docs.inputFiles() if (m := re.search(r"/part-(\d+)[^/]*$", f))]
    part = F.coalesce(F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("int"), F.lit(0))
    out = queries.encoded(placed, "__file", "__row").repartitionById(max(parts, default=0) + 1, part)
    return out.sortWithinPartitions("__file", "__row").drop("__file", "__row")


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near_dedup", near_dedup), ("mix", mixed), ("pieces", tokens)]

#: Models and simulations that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
