"""Operator 4: quality rules as weak supervision, in DataFrame functions only.

Each rule votes fine (1), junk (2) or abstains (0). Votes of a document are one of 3 ** 7 patterns; their
counts, taken over all documents with a partial aggregation, are all that expectation-maximisation needs: it
fits, without labels, how often each rule casts each vote on fine documents and on each kind of junk, and the
shares of these. The posterior of a document's pattern replaces "every rule must pass": one rule that is often wrong does
not reject a document, several that agree do. The fit is an aggregate() over at most 2,187 counts in one row;
its posteriors go back to the documents by a join on the pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words, written

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_stutter", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
#: Bounds of the votes: (SQL for junk, SQL for fine); neither: the rule abstains.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "letters": ("n_letters < 0.7 * word_chars and n_words >= 20", "n_letters >= 0.94 * word_chars and n_words > 0"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "n_repeat_words = 0 and n_words >= 10"),
    "duplicate_lines": ("n_dup_lines > 0.4 * n_lines and n_lines >= 3", "n_dup_lines = 0 and n_lines >= 3"),
    "stutter": ("n_stutter > 0.15 * n_words", "n_stutter <= 0.05 * n_words and n_words >= 10"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words and n_words > 0"),
    "length": ("n_words < 5", "n_words >= 20"),
}
#: Kinds of documents: their share, and the rules that see them as junk. One junk class would not do: votes of
#: rules that see the same fault depend on each other, and the commonest fault would then pass for junk as such.
CLASSES = {"fine": (0.9, ()), "markup": (0.04, ("symbols", "letters")), "repetition": (0.04, ("repeats", "duplicate_lines", "stutter")), "fragment": (0.02, ("length", "word_length"))}
#: What a rule that votes is taken to say before any count is seen, as P(fine, junk), and the weight of that belief
#: in documents: it fixes which class is which and bounds what few counts can do. Abstaining says nothing.
ITERATIONS, CALM, ALARM, BELIEF = 40, (0.97, 0.03), (0.25, 0.75), 50.0


def _repeat_words(n: Column) -> Column:
    """Words within WINDOW-word windows that occur twice or more. windows: their hashes, in order."""
    w = "array_sort(transform(windows, (h, i) -> struct(h, i)))"
    marked = "filter(s, (x, j) -> get(s, j - 1).h <=> x.h or get(s, j + 1).h <=> x.h)"
    at = f"array_sort(transform({marked}, x -> x.i))"
    # One-element arrays bind a value for use within a lambda, so that it's computed once.
    covered = f"aggregate(transform(array({w}), s -> aggregate(transform(array({at}), p -> aggregate(transform(p, (x, j) -> least({WINDOW}, coalesce(get(p, j + 1), x + {WINDOW}) - x)), 0, (a, b) -> a + b)), 0, (a, b) -> a + b)), 0, (a, b) -> a + b)"
    return F.when(F.size(F.array_distinct("windows")) == n, F.lit(0)).otherwise(F.expr(covered)).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns and word counts; names of the counts must be free. Null text: no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    df = docs.select(*keep, t.alias("__text"), words(t).alias("__words"))
    df = df.select(
        *keep, "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    of = ", ".join(f"get(__h, i + {k})" for k in range(WINDOW))
    df = df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_letters",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(filter(__h, (x, i) -> i > 0 and get(__h, i - 1) = x))").cast("long").alias("n_stutter"),
        F.when(F.size("__h") >= WINDOW, F.expr(f"transform(sequence(0, size(__h) - {WINDOW}), i -> xxhash64({of}))")).otherwise(F.expr("cast(array() as array<bigint>)")).alias("windows"),
    )
    return df.withColumn("n_repeat_words", _repeat_words(F.size("windows"))).drop("windows")


def pattern() -> Column:
    """The votes as a number in base 3, the first rule's last."""
    return F.expr(" + ".join(f"{3**k} * case when {junk} then 2 when {fine} then 1 else 0 end" for k, (junk, fine) in enumerate(RULES.values()))).cast("int")


def label_model(patterns: DataFrame) -> DataFrame:
    """patterns(pattern, n) -> (pattern, p_fine): the posterior of the fine class under the fitted model.

    th[c][0] is the log share of class c, th[c][1 + 3 r + v] the log probability that a vote of rule r there is v.
    """
    belief = [[share] + [b for rule in RULES for b in (1.0, *(ALARM if rule in seen else CALM))] for share, seen in CLASSES.values()]
    array = lambda rows: "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in rows) + ")"
    first = array([[math.log(x) for x in row] for row in belief])
    joint = "transform(th, tc -> aggregate(p.ix, get(tc, 0), (a, i) -> a + get(tc, i)))"
    # One-element arrays bind a value for use within a lambda, so that it's computed once.
    softmax = f"get(transform(array({joint}), l -> get(transform(array(transform(l, x -> exp(x - array_max(l)))), e -> transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))), 0)), 0)"
    shares = f"transform(pats, p -> struct(p.ix as ix, transform({softmax}, x -> x * p.n) as w))"
    total = "aggregate(q, 0D, (a, p) -> a + get(p.w, c))"
    seen = "aggregate(filter(q, p -> array_contains(p.ix, i)), 0D, (a, p) -> a + get(p.w, c))"
    voted = "aggregate(filter(q, p -> array_contains(p.ix, i + 1 - (i - 1) % 3) or array_contains(p.ix, i + 2 - (i - 1) % 3)), 0D, (a, p) -> a + get(p.w, c))"
    row = f"get(transform(array({total}), t -> transform(b, (x, i) -> case when i = 0 then ln((t + x * {BELIEF}D) / (n_all + {BELIEF}D)) when (i - 1) % 3 = 0 then 0D else ln(({seen} + x * {BELIEF}D) / ({voted} + {BELIEF}D)) end)), 0)"
    m_step = f"get(transform(array({shares}), q -> transform(belief, (b, c) -> {row})), 0)"
    votes = ", ".join(f"cast({1 + 3 * r} + floor(pattern / {3**r}) % 3 as int)" for r in range(len(RULES)))
    one = patterns.select(F.struct("pattern", F.expr(f"filter(array({votes}), y -> (y - 1) % 3 <> 0)").alias("ix"), F.col("n").cast("double").alias("n")).alias("p")).agg(F.sort_array(F.collect_list("p")).alias("pats"), F.sum("p.n").alias("n_all"))
    one = one.withColumn("belief", F.expr(array(belief)))
    fit = one.selectExpr("pats", f"aggregate(sequence(1, {ITERATIONS}), {first}, (th, k) -> {m_step}) as th")
    return fit.selectExpr("th", "explode(pats) as p").selectExpr("p.pattern", f"get({softmax}, 0) as p_fine")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with the counts, base_failed, p_fine (0 to 1) and kept (see COUNTS); columns of those names are
    replaced, and any others are kept, whatever their names.

    base_failed: fewer than ten words, or more than a fifth of them within repeated five-word windows. kept:
    not base_failed and p_fine >= 0.5. Texts that are null, empty or without words fail the base; equal texts
    get equal verdicts; an empty table gives an empty one.
    """
    names = [*COUNTS, "base_failed", "p_fine", "kept"]
    others = [c for c in docs.columns if c != text and c.lower() not in names]
    # As one struct they meet none of the names in use here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__rest") if others else F.lit(0).alias("__rest"), F.col(f"`{text}`").alias("text"))
    f = written(features(rows).withColumn("pattern", pattern()), "quality")
    post = label_model(f.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    out = f.join(F.broadcast(post), "pattern")  # 3 ** 7 rows at most
    out = out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_fine") >= 0.5)).select(*(["__rest.*"] if others else []), *names)
