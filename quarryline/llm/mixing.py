"""Operator 1: mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source with `a` of `P` parts is due `a / P` of every stretch of blocks while all sources last; a source
that has run out leaves its share to the others, in proportion to theirs. In that fluid schedule block k of
a source occupies one stretch of time; its release is the stretch's start rounded down, its deadline the end
rounded up, and one block is emitted per slot, earliest deadline first among the released blocks. Unit blocks
with such windows always fit (the fluid schedule is the witness), so at no time is a source a whole block away
from its target.

Weights are whole numbers of parts. After every P blocks ("cycle") each source has had exactly its parts, so
all deviations are zero and the schedule starts over: cycles with the same sources left are alike. A source
ends in one cycle, so there are at most 2N + 1 kinds of cycle for N sources, and only those are scheduled.
Rows find their slot by a join on (source, block within the cycle); no task ever sees a whole source's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import replaced, written

#: A slot table of up to this many rows is broadcast; a longer one is written out by block and joined by key.
BROADCAST_ROWS = 100_000
SEED = 17
RESULTS = ("mix_block", "mix_slot", "mix_position")


def _key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _parts(key: Column, parts: dict[str, int], default: int) -> Column:
    if default < 1 or any(v < 1 for v in parts.values()):
        raise ValueError("parts are whole numbers of at least 1")
    out = F.lit(default)
    for source, n in sorted(parts.items()):
        out = F.when(key == "=" + source, n).otherwise(out)
    return out.cast("long")


def slot_table(sources: DataFrame) -> DataFrame:
    """sources(key, a, blocks) -> (key, k, e, until, t0, cycle_len, slot): in every cycle v with e <= v < until,
    block k (from 0) of the source's share goes to slot t0 + (v - e) * cycle_len + slot.

    Sources of equal parts and equal shares in a cycle have equal windows, so each kind of cycle is scheduled, in a row
    of its own, over such classes: their jobs are (class, k), of as many blocks as the class has sources. A job runs
    until it's done or the next release, which gives runs of slots; within a run the class's sources come by key. A
    row here stands for at least one block, so there are never more rows than blocks.
    """
    live = sources.where("blocks > 0")
    ends = live.select(F.explode(F.expr("array(0L, blocks div a, (blocks + a - 1) div a)")).alias("e")).distinct().agg(F.array_sort(F.collect_list("e")).alias("b"))
    # At most about 2 * sqrt(2 * blocks) kinds, as sources that end in different cycles have different sizes.
    kinds = "transform(sequence(0, size(b) - 2), i -> struct(b[i] as e, b[i + 1] as until))"
    pairs = live.crossJoin(F.broadcast(ends)).where("size(b) > 1").select("key", "a", "blocks", F.explode(F.expr(f"filter({kinds}, z -> z.e * a < blocks)")).alias("z"))
    pairs = pairs.selectExpr("key", "a", "z.e as e", "z.until as until", "least(a, blocks - z.e * a) as m")
    by_class = pairs.groupBy("e", "until", "a", "m").agg(F.count(F.lit(1)).alias("c"))
    by_kind = by_class.groupBy("e", "until").agg(F.sort_array(F.collect_list(F.struct("a", "m", "c"))).alias("s"))
    by_kind = by_kind.withColumn("cycle_len", F.expr("aggregate(s, 0L, (t, x) -> t + x.m * x.c)"))
    by_kind = by_kind.withColumn("t0", F.coalesce(F.sum(F.expr("(until - e) * cycle_len")).over(W.orderBy("e").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Windows of block k of a source of class x: time, as a multiple of 1 / x.a, at which the fluid schedule starts and ends it.
    at = "aggregate(s, 0L, (t, y) -> t + y.c * least({k} * y.a, y.m * x.a))"
    jobs = f"array_sort(flatten(transform(s, (x, i) -> transform(sequence(0L, x.m - 1), k -> struct(({at.format(k='(k + 1)')} + x.a - 1) div x.a as d, i as i, k as k, {at.format(k='k')} div x.a as r, x.c as c)))))"
    # Of the released jobs with blocks left the one with the earliest deadline, then the first: jobs are in that order.
    # One-element arrays bind a value for use within a lambda, so that it's computed once.
    ready = "array_min(array_compact(transform(jobs, (j, n) -> if(j.r <= st.t and get(st.todo, n) > 0, n, null))))"
    run = "least(get(st.todo, p), coalesce(array_min(transform(filter(jobs, j -> j.r > st.t), j -> j.r)) - st.t, get(st.todo, p)))"
    out = "struct(get(jobs, p).i as i, get(jobs, p).k as k, get(jobs, p).c - get(st.todo, p) as first, w as n, st.t as slot)"
    step = f"(st, q) -> get(transform(array({ready}), p -> if(p is null, st, get(transform(array({run}), w -> named_struct('t', st.t + w, 'todo', transform(st.todo, (x, n) -> if(n = p, x - w, x)), 'out', concat(st.out, array({out})))), 0))), 0)"
    # Each step ends a job or reaches a release, so twice as many steps as jobs are enough.
    start = "named_struct('t', 0L, 'todo', transform(jobs, j -> j.c), 'out', cast(array() as array<struct<i: int, k: bigint, first: bigint, n: bigint, slot: bigint>>))"
    edf = by_kind.repartition("e").withColumn("jobs", F.expr(jobs)).withColumn("runs", F.expr(f"aggregate(sequence(1, 2 * size(jobs)), {start}, {step}).out"))
    runs = edf.select("e", "s", "t0", "cycle_len", F.explode("runs").alias("r")).selectExpr("e", "s[r.i].a as a", "s[r.i].m as m", "t0", "cycle_len", "r.k as k", "r.first as first", "r.n as n", "r.slot as start")
    members = pairs.withColumn("j", F.row_number().over(W.partitionBy("e", "a", "m").orderBy("key")) - 1)
    slots = members.join(runs, ["e", "a", "m"]).where("j >= first and j < first + n")
    return slots.selectExpr("key", "k", "e", "until", "t0", "cycle_len", "start + j - first as slot")


def mix_order(docs: DataFrame, parts: dict[str, int], default_parts: int = 4, block_rows: int = 16, source: str = "source", row_id: str = "doc_id", buckets: int = 4096) -> DataFrame:
    """docs plus mix_block (of its source, from 0), mix_slot (place of the block in the mix), mix_position
    (mix_slot * block_rows + place in the block: unique and ascending in mixed order, with gaps after a
    source's last, shorter block).

    Every row comes out once: nothing is repeated or left out to reach a weight. Within a source, rows come
    in the order of a hash of row_id, then of row_id, then of the whole row's hash (equal rows are
    interchangeable). Any number of sources. Null sources form one source; null ids are ids like others. Empty in, empty out. docs
    may have any other columns; those named as the three are replaced.
    """
    if any(c.lower().startswith("__mix_") for c in docs.columns):  # as one struct they meet none of the names in use here
        kept = replaced(docs, *RESULTS).columns
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{row_id}`").alias("row_id"))
        return mix_order(rows, parts, default_parts, block_rows, "source", "row_id", buckets).select("row.*", *RESULTS)
    docs = replaced(docs, *RESULTS)
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, _key(F.col(source)).alias("__mix_key"), F.xxhash64(F.lit(SEED), F.col(row_id)).alias("__mix_h"))
    rows = rows.withColumn("__mix_bucket", F.pmod(F.shiftrightunsigned("__mix_h", 20), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("__mix_key", "__mix_bucket").agg(F.count(F.lit(1)).alias("__mix_n"))
    before = W.partitionBy("__mix_key").orderBy("__mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__mix_key", "__mix_bucket", F.coalesce(F.sum("__mix_n").over(before), F.lit(0)).alias("__mix_before"))
    sizes = counts.groupBy("__mix_key").agg(F.sum("__mix_n").alias("n"))
    sources = sizes.select(F.col("__mix_key").alias("key"), _parts(F.col("__mix_key"), parts, default_parts).alias("a"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    slots = written(slot_table(sources), "slots")
    inner = W.partitionBy("__mix_key", "__mix_bucket").orderBy("__mix_h", row_id, "__mix_row")
    ranked = rows.withColumn("__mix_row", F.xxhash64(*own) if len(own) > 1 else F.lit(0)).withColumn("__mix_rn", F.row_number().over(inner))
    ranked = ranked.join(offsets, ["__mix_key", "__mix_bucket"]).withColumn("__mix_rank", F.col("__mix_before") + F.col("__mix_rn") - 1)
    ranked = ranked.withColumn("mix_block", F.expr(f"__mix_rank div {block_rows}")).withColumn("__mix_a", _parts(F.col("__mix_key"), parts, default_parts))
    ranked = ranked.withColumn("__mix_v", F.expr("mix_block div __mix_a")).withColumn("__mix_k", F.expr("mix_block % __mix_a"))
    if slots.count() <= BROADCAST_ROWS:
        slots = slots.select(*[F.col(c).alias(f"__mix_s_{c}") for c in slots.columns])
        on = (F.col("__mix_key") == F.col("__mix_s_key")) & (F.col("__mix_k") == F.col("__mix_s_k")) & (F.col("__mix_v") >= F.col("__mix_s_e")) & (F.col("__mix_v") < F.col("__mix_s_until"))
        out = ranked.join(F.broadcast(slots), on)  # BROADCAST_ROWS at most
        out = out.withColumn("mix_slot", F.expr("__mix_s_t0 + (__mix_v - __mix_s_e) * __mix_s_cycle_len + __mix_s_slot"))
    else:
        blocks = slots.join(sources.select("key", "a", "blocks"), "key").withColumn("v", F.explode(F.expr("sequence(e, until - 1)"))).withColumn("mix_block", F.expr("v * a + k"))
        blocks = blocks.where("mix_block < blocks").select(F.col("key").alias("__mix_key"), "mix_block", F.expr("t0 + (v - e) * cycle_len + slot").alias("mix_slot"))
        out = ranked.join(blocks, ["__mix_key", "mix_block"])  # one row a block, each matched by block_rows rows at most
    out = out.withColumn("mix_position", F.expr(f"mix_slot * {block_rows} + __mix_rank % {block_rows}"))
    return out.select(*own, "mix_block", "mix_slot", "mix_position")


def mix(docs: DataFrame, parts: dict[str, int], default_parts: int = 4, block_rows: int = 16, source: str = "source", row_id: str = "doc_id") -> DataFrame:
    """The rows of docs, same columns, in mixed order: range-partitioned and sorted, so files written from it are in order."""
    clash = any(c.lower() in RESULTS for c in docs.columns)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{row_id}`").alias("row_id")) if clash else docs
    out = mix_order(rows, parts, default_parts, block_rows, "source", "row_id") if clash else mix_order(docs, parts, default_parts, block_rows, source, row_id)
    out = out.repartitionByRange(F.col("mix_position")).sortWithinPartitions("mix_position")
    return out.select("row.*") if clash else out.drop(*RESULTS)
