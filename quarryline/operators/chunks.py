"""Line windows and the symbols that label them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def line_windows(files: DataFrame, keys: list[str], text: str, lines: int = 60, overlap: int = 10) -> DataFrame:
    """(keys, ordinal, start_line, end_line, chunk): windows of so many lines, each sharing overlap with the one
    before; the last ends with the file and no window lies within another."""
    step = lines - overlap
    df = files.select(*keys, F.split(text, "\n").alias("__l"))
    last = F.greatest(F.ceil((F.size("__l") - lines) / F.lit(step)), F.lit(0)).cast("int")
    # Windows are cut before they become rows, so that no row carries the whole file.
    window = lambda i: F.struct(i.alias("ordinal"), (i * step + 1).alias("start_line"), F.least(i * step + lines, F.size("__l")).alias("end_line"), F.array_join(F.slice("__l", i * step + 1, lines), "\n").alias("chunk"))
    return df.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("__w")).select(*keys, "__w.*")


def best_overlap(left: DataFrame, right: DataFrame, on: list[str], order: list, bin_lines: int = 64) -> DataFrame:
    """left ⟕ right where line ranges overlap, one row of right for each of left: the greatest overlap, then order.

    left(on, lid, l_start, l_end), right(on, r_start, r_end, ...). Ranges are put into bins of lines, so that the
    join is an equi join on (on, bin); a pair counts in the first bin it shares.
    """
    bins = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {bin_lines}"), F.expr(f"{b} div {bin_lines}"))).alias("__bin")
    a = left.select("*", bins("l_start", "l_end"))
    b = right.select("*", bins("r_start", "r_end"))
    pairs = a.join(b, [*on, "__bin"]).where("l_start <= r_end and r_start <= l_end").where(f"__bin = greatest(l_start, r_start) div {bin_lines}")
    pairs = pairs.withColumn("overlap", F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1)
    rank = F.row_number().over(W.partitionBy(*on, "lid").orderBy(F.desc("overlap"), *order))
    best = pairs.withColumn("__n", rank).where("__n = 1").drop("__n", "__bin", "l_start", "l_end")
    return left.join(best, [*on, "lid"], "left")
