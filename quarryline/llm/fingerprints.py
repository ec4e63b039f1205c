"""Operator 8: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of five-word shingles weighted by how often they occur. For sample k and a shingle of weight w,
hashes of (shingle, k) give r and c from Gamma(2, 1) and b from [0, 1); with t = floor(ln w / r + b) the value
ln c - r (t - b + 1) competes, and the shingle and t of the least value are the sample. Two texts draw the
same sample with a probability equal to their generalised Jaccard similarity (sum of minima over sum of
maxima), so the share of equal samples estimates it, with a standard deviation of 0.09 at most. Every sample
has its own r, b and c.

Values and sample ids are packed into one long, so that sampling is a hash aggregation of plain minima, a row
for every PER_ROW samples of a shingle (code for more at once gets too large to be compiled well): the shingles of a text are generated and aggregated within the task that
holds the text. A text and its edited form share most shingles; one that weighs the same in both is drawn for once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, written

SHINGLE, SAMPLES, PER_ROW = 5, 32, 4
CELLS, STEPS = 1024, 32
#: Documents to a bucket of neighbouring ids, about.
BUCKET_ROWS = 256
QUANTILES = 128
_ID = (1 << 31) - 1


def _hashes(df: DataFrame, texts: list[str], out: list[str]) -> DataFrame:
    """df with out, for each of the texts the hashes of its shingles, instead of them; a text of fewer words is one
    shingle, one without words (or null) none."""
    keep = [c for c in df.columns if c not in texts]
    words = [F.transform(F.filter(F.split(F.coalesce(t, F.lit("")), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias(o) for t, o in zip(texts, out, strict=True)]
    df = df.select(*keep, *words)
    of = lambda o: ", ".join(f"get({o}, i + {k})" for k in range(SHINGLE))
    return df.select(*keep, *[F.expr(f"case when size({o}) >= {SHINGLE} then transform(sequence(0, size({o}) - {SHINGLE}), i -> xxhash64({of(o)})) when size({o}) > 0 then array(xxhash64({o})) else cast(array() as array<bigint>) end").alias(o) for o in out])


def weighted_shingles(df: DataFrame, texts: list[str], out: str) -> DataFrame:
    """df plus out, array<struct(side, t, w)>, instead of the texts: shingles t of the text numbered side (0 to 2) and
    how often they occur there. Side 3 stands for 0 and 1 both, where the shingle occurs equally often."""
    keep = [c for c in df.columns if c not in texts]
    sides = [f"__s{i}" for i in range(len(texts))]
    df = _hashes(df, texts, sides)
    # The last two bits tell the sides apart, so that equal shingles of several sides are neighbours.
    marks = ", ".join(f"transform({s}, h -> h & -4L | {i}L)" for i, s in enumerate(sides))
    df = df.select(*keep, F.expr(f"sort_array(concat({marks}))").alias("__s"))
    # A shingle's last place gives its row, with the distance to its first as weight. Where none occurs twice on a side, all
    # weights are 1, which spares the looking back.
    last = "i = n - 1 or get(__s, i) <> get(__s, i + 1)"
    df = df.select(*keep, "__s", F.size("__s").alias("__n"), (F.size(F.array_distinct("__s")) < F.size("__s")).alias("__twice"))
    ends = f"case when __n = 0 then cast(array() as array<int>) when __twice then filter(sequence(0, __n - 1), i -> {last.replace('n - 1', '__n - 1')}) end"
    df = df.select(*keep, "__s", "__n", F.expr(ends).alias("__e"))
    runs = "transform(__e, (p, j) -> struct(get(__s, p) as h, p - coalesce(get(__e, j - 1), -1) as w))"
    df = df.select(*keep, "__s", "__n", F.expr(f"case when __e is not null then {runs} end").alias("__r"))
    both = "get(__r, j + 1).h = (x.h | 1L) and get(__r, j + 1).w = x.w and x.h & 3 = 0"
    again = "get(__r, j - 1).h = (x.h & -2L) and get(__r, j - 1).w = x.w and x.h & 3 = 1"
    many = f"array_compact(transform(__r, (x, j) -> case when {again} then null else struct(cast(if({both}, 3, x.h & 3) as int) as side, shiftright(x.h, 2) as t, x.w as w) end))"
    # Of sides 0 and 1 both have the shingle if the next (or the one before) differs in the last bit only.
    once = "transform(__s, (h, i) -> if(h & 3 = 1 and get(__s, i - 1) <=> (h & -2L), null, struct(if(h & 3 = 0 and get(__s, i + 1) <=> (h | 1L), 3, cast(h & 3 as int)) as side, shiftright(h, 2) as t, 1 as w)))"
    return df.select(*keep, F.expr(f"case when __r is not null then {many} else array_compact({once}) end").alias(out))


def _gamma_quantile(u: float) -> float:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + c) exp(-c)."""
    low, high = 0.0, 64.0
    for _ in range(60):
        c = (low + high) / 2
        low, high = (c, high) if -math.expm1(-c) - c * math.exp(-c) < u else (low, c)
    return (low + high) / 2


def _tables(spark: SparkSession) -> tuple[Column, Column, Column]:
    """Tables as subqueries of one row: -ln at the middles of CELLS cells; quantiles of Gamma(2, 1) at squares of i / CELLS; exp(-i / STEPS)."""
    logs = [-math.log((i + 0.5) / CELLS) for i in range(CELLS)]
    gamma = [_gamma_quantile((i / CELLS) ** 2) for i in range(CELLS)] + [_gamma_quantile(1 - 0.5 / CELLS)]
    powers = [math.exp(-i / STEPS) for i in range(48 * STEPS)]
    row = spark.createDataFrame([(logs, gamma, powers)], "l array<double>, g array<double>, e array<double>")
    return tuple(row.select(c).scalar() for c in ("l", "g", "e"))


def samples(rows: DataFrame, keys: list[str], drawn: Column | None = None) -> DataFrame:
    """rows(keys, t, w) -> (keys, g, t, m): the greatest t; m has the minima of samples g * PER_ROW and so on, whose bits 31 and up are the
    value, the others say which shingle and step it was; null for a text without shingles. Rows that are not drawn for, but only
    carry their t, come out for g = 0 alone.

    A sample's draws come from one hash: 32 bits for c, by interpolation between quantiles; twice 10 for r, the sum of
    two exponential draws; 12 for b. Spark's logarithms are slow, so these come from tables, and values are compared as
    c exp(-r (t - b + 1)), which orders them as its logarithm does.
    """
    logs, gamma, powers = _tables(rows.sparkSession)
    bits = lambda h, low, n: F.shiftrightunsigned(h, low).bitwiseAND((1 << n) - 1)
    each, each_g = range(PER_ROW), F.array(*[F.lit(g) for g in range(SAMPLES // PER_ROW)])
    rows = rows.select(*keys, "t", F.log(F.col("w").cast("double")).alias("lw"), F.explode(each_g if drawn is None else F.when(drawn, each_g).otherwise(F.array(F.lit(0)))).alias("g"))
    rows = rows.select(*keys, "g", "t", "lw", *[F.xxhash64("t", F.col("g") * PER_ROW + k).alias(f"h{k}") for k in each])
    rows = rows.select(*keys, "g", "t", "lw", *[x for k in each for h in [F.col(f"h{k}")] for x in (
        h, (F.get(logs, bits(h, 32, 10).cast("int")) + F.get(logs, bits(h, 42, 10).cast("int"))).alias(f"r{k}"),
        ((F.shiftrightunsigned(h, 52) + 0.5) * (1 / 4096.0)).alias(f"b{k}"), (F.sqrt((bits(h, 0, 32) + 0.5) * (1 / float(1 << 32))) * float(CELLS)).alias(f"c{k}"))])
    rows = rows.select(*keys, "g", "t", *[x for k in each for x in (f"h{k}", f"c{k}", f"r{k}", f"b{k}", F.floor(F.col("lw") / F.col(f"r{k}") + F.col(f"b{k}")).alias(f"s{k}"))])
    rows = rows.select(*keys, "g", "t", *[x for k in each for x in (f"h{k}", f"s{k}", f"c{k}", F.col(f"c{k}").cast("int").alias(f"i{k}"), (F.col(f"r{k}") * (F.col(f"s{k}") - F.col(f"b{k}") + 1) * float(STEPS)).alias(f"x{k}"))])
    out = []
    for k in each:
        i, x, d = F.col(f"i{k}"), F.col(f"x{k}").cast("int"), (F.col(f"x{k}") - F.col(f"x{k}").cast("int")) * (1 / float(STEPS))
        low = F.get(gamma, i)
        value = (low + (F.col(f"c{k}") - i) * (F.get(gamma, i + 1) - low)) * F.get(powers, x) * (1 - d * (1 - d * 0.5 * (1 - d * (1 / 3.0))))
        which = F.shiftrightunsigned(f"h{k}", 33).bitwiseXOR(F.col(f"s{k}") * 40503).bitwiseAND(_ID)
        out.append(F.min(F.when(F.col("t").isNotNull(), F.shiftleft((value * float(1 << 27)).cast("long"), 31).bitwiseOR(which))).alias(f"m{k}"))
    return rows.groupBy(*keys, "g").agg(F.max("t").alias("t"), *out).select(*keys, "g", "t", F.array(*[f"m{k}" for k in each]).alias("m"))


def signature(found: str, sides: tuple[int, ...] = (0,)) -> Column:
    """Sample ids from an array<struct(side, g, m)>: the least values of the sides; 0 where there is none."""
    least = "zip_with(a, x.m, (p, q) -> least(p, q))"
    of = f"aggregate(filter({found}, x -> x.g = g and x.side in ({', '.join(map(str, sides))})), array_repeat(cast(null as bigint), {PER_ROW}), (a, x) -> {least})"
    return F.expr(f"transform(flatten(transform(sequence(0, {SAMPLES // PER_ROW - 1}), g -> {of})), v -> cast(coalesce(v & {_ID}, 0) as int))")


def fingerprint(df: DataFrame, keys: list[str], texts: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """df(keys, same, texts), up to three texts -> (keys, same, sig0, sig1, ...): arrays of SAMPLES sample ids, all 0 for a
    text without words (or null).

    The keys must tell the rows apart, and all rows are looked up by them, so they should be short. same are other
    columns, longs; each comes along as a row of its own, like a shingle, of a side from 8 on. If df is partitioned by some
    of the keys, nothing is shuffled.
    """
    rows = weighted_shingles(df.select(*keys, *same, *texts), texts, "__terms")
    more = [F.struct(F.lit(8 + i).alias("side"), F.col(c).cast("long").alias("t"), F.lit(1).alias("w")) for i, c in enumerate(same)]
    rows = rows.select(*keys, F.explode_outer(F.concat("__terms", F.array(*more)) if same else F.col("__terms")).alias("__x")).select(*keys, F.coalesce("__x.side", F.lit(0)).alias("side"), "__x.t", "__x.w")
    found = samples(rows, [*keys, "side"], F.col("side") < 8 if same else None).groupBy(*keys).agg(F.collect_list(F.struct("side", "g", "t", "m")).alias("__m"))
    both = {0: (0, 3), 1: (1, 3), 2: (2,)}
    return found.select(*keys, *[F.expr(f"get(filter(__m, x -> x.side = {8 + i}), 0).t").alias(c) for i, c in enumerate(same)], *[signature("__m", both[i]).alias(f"sig{i}") for i in range(len(texts))])


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(SAMPLES))


def ranges(docs: DataFrame) -> Column:
    """The number of the range of about BUCKET_ROWS neighbours, by (doc_id, hash of text), that a row is in.

    A row's place is estimated from QUANTILES quantiles of the ids, evenly in between, and by the hash among rows of
    one id that fill several quantiles (or have none); so neither odd ids nor a frequent one make a large range.
    """
    stats = docs.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.percentile_approx(F.col("doc_id").cast("long"), [i / QUANTILES for i in range(QUANTILES + 1)], 100 * QUANTILES).alias("q")).first()
    part = F.xxhash64("text").cast("double") / float(1 << 64) + 0.5
    nulls = F.floor(part * ((stats.rows - stats.n) / BUCKET_ROWS)) - F.lit((stats.rows - stats.n) // BUCKET_ROWS + 1)
    if not stats.n:
        return nulls.cast("long")
    q = F.array(*[F.lit(x).cast("long") for x in stats.q])
    x = F.col("doc_id").cast("long")

    def at(below: Column, upto: Column) -> Column:
        low, high = F.get(q, below - 1).cast("double"), F.get(q, below).cast("double")
        between = F.when(below == 0, F.lit(0.0)).when(upto == below, below - 1 + (x - low) / (high - low)).otherwise(below.cast("double"))
        return F.when(upto > below + 1, below + part * (upto - below - 1)).otherwise(F.coalesce(between, F.lit(float(QUANTILES))))

    # How many quantiles are less, or at most x, by halves: 8 looks instead of 129. A one-element array binds both numbers.
    halves = F.array(*[F.lit(1 << i) for i in range((QUANTILES + 1).bit_length() - 1, -1, -1)])
    search = lambda before: F.aggregate(halves, F.lit(0), lambda n, step: F.when(before(F.get(q, n + step - 1)), n + step).otherwise(n))
    place = F.get(F.transform(F.array(F.struct(search(lambda v: v < x).alias("below"), search(lambda v: v <= x).alias("upto"))), lambda s: at(s.below, s.upto)), F.lit(0))
    return F.when(x.isNull(), nulls).otherwise(F.floor(place * (stats.n / QUANTILES / BUCKET_ROWS))).cast("long")


def with_edited(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Other columns are ignored.

    Documents are ordered by doc_id (null first), then the XXH64 of the text (seed 42, signed), then text; the one after
    the last is the first. Null text: empty. The edited text is the text whose last n_chars div 4 code points are
    replaced by the first as many, or all, of the next document. Rows are dealt to tasks by ranges() of them. Each
    range needs one row from beyond it: the first of the next range, which comes by a join of one row per range.
    No rows, none out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = ranges(docs)
    rows = docs.select(bucket.alias("b"), "doc_id", "text", F.xxhash64("text").alias("h")).repartition("b")
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text")]
    head = rows.groupBy("b").agg(F.min_by("text", F.struct(F.col("doc_id").isNotNull(), "doc_id", "h", "text")).alias("far_text"))
    # The range before each, first within runs of 1,024 ranges, then among the runs; before the first comes the last. The heads, a
    # row for each range, are written, so that the documents are not read again for the numbers of the ranges.
    head = written(head, "heads")
    runs = head.select("b").withColumn("run", F.expr("b div 1024 - if(b < 0, 1, 0)"))
    by_run = runs.groupBy("run").agg(F.max("b").alias("last"))
    by_run = by_run.select("run", F.coalesce(F.lag("last").over(W.orderBy("run")), F.max("last").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before_run"))
    links = runs.withColumn("before", F.lag("b").over(W.partitionBy("run").orderBy("b"))).join(by_run, "run").select("b", F.coalesce("before", "before_run").alias("before"))
    far = head.join(links, "b").select(F.col("before").alias("b"), "far_text")
    inner = W.partitionBy("b").orderBy(*order)
    rows = rows.select("b", "doc_id", "text", F.row_number().over(inner).alias("rn"), F.lead("text").over(inner).alias("near_text"), F.lead(F.lit(True)).over(inner).isNull().alias("last"))
    rows = rows.join(far, "b").select("b", "rn", "doc_id", "text", F.when(F.col("last"), F.col("far_text")).otherwise(F.col("near_text")).alias("next"), "last")
    n = F.length("text")
    rows = rows.select("b", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.expr("left(next, cast(length(text) div 4 as int))")).alias("edited"), F.when(F.col("last"), F.col("next")).alias("far"))
    # The next document's fingerprint is found among the range's own, but for the last one's.
    rows = rows.withColumn("sha", F.sha2("edited", 256)).withColumn("last", F.col("far").isNotNull().cast("long"))
    parts = [f"sha{i}" for i in range(4)]
    rows = rows.select("*", *[F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(p) for i, p in enumerate(parts)])
    sigs = fingerprint(rows, ["b", "rn"], ["text", "edited", "far"], ("doc_id", "n_chars", "last", *parts))
    sigs = sigs.withColumn("sha", F.lower(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts])))
    out = sigs.withColumn("next_sig", F.when(F.col("last") == 1, F.col("sig2")).otherwise(F.lead("sig0").over(W.partitionBy("b").orderBy("rn"))))
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_string(F.col("sig0")).alias("fingerprint"), as_string(F.col("sig1")).alias("edited_fingerprint"), likeness(F.col("sig0"), F.col("sig1")).alias("near_edited"), likeness(F.col("sig0"), F.col("next_sig")).alias("near_next"))
