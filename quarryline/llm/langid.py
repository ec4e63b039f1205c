"""Operator 5: language identification by word-first backoff.

A word that training has seen adds its log frequency in each language. An unseen word adds the mean of those of
its character 5-grams (with marks at both ends) that are known, or else of its 4-grams, and so on down to single
characters. The posterior over languages, each as likely beforehand, gives prediction and score.

The model is fitted on a bounded sample of labelled rows: about PER_LANGUAGE documents of each language, chosen by a
hash of the id. It holds the WORDS commonest words and the GRAMS commonest
n-grams of each order of each language, so its size is bounded and it is broadcast. Texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Held, replaced, training_row, written

PER_LANGUAGE, WORDS, GRAMS, ORDERS = 600, 40_000, 10_000, (5, 4, 3, 2, 1)
#: A language with fewer training documents is not learned.
MIN_DOCUMENTS = 3
_TOKEN = re.compile(r"[^\W\d_]+")
_CACHE = 20_000


class Model:
    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]]) -> None:
        self.languages, self.grams = languages, grams
        self.ids = {w: i for i, w in enumerate(words)}
        self.table = np.array(list(words.values())).reshape(len(words), len(languages))
        self.seen: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        if (v := self.seen.get(word)) is None:
            marked, v = f"^{word}$", np.zeros(len(self.languages))
            for n in ORDERS:
                known = [g for i in range(len(marked) - n + 1) if (g := self.grams[n].get(marked[i : i + n])) is not None]
                if known:
                    v = np.mean(known, axis=0)
                    break
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            self.seen[word] = v
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        tokens = _TOKEN.findall((text or "").lower())
        if not tokens or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        found = [self.ids.get(t, -1) for t in tokens]
        ids = np.array(found)
        total = self.table[ids[ids >= 0]].sum(0)
        for word, n in Counter(t for t, i in zip(tokens, found, strict=True) if i < 0).items():
            total = total + n * self.backoff(word)
        p = np.exp(total - total.max())
        best = int(p.argmax())  # the first in alphabetical order wins ties
        return self.languages[best], float(p[best] / p.sum())


def _log_frequencies(counts: dict[str, dict[str, int]], languages: list[str], most: int) -> dict[str, np.ndarray]:
    """Of the commonest entries of each language; an entry missing in a language counts as half seen there."""
    total = {lang: sum(c.values()) + 1 for lang, c in counts.items()}
    chosen = dict.fromkeys(w for lang in languages for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:most])
    return {w: np.array([np.log((counts[lang].get(w, 0) + 0.5) / total[lang]) for lang in languages]) for w in chosen}


def fit(docs: DataFrame) -> Model:
    """docs(doc_id, text, lang). Only training rows with a lang and a text count; a language of fewer than MIN_DOCUMENTS
    of them is not learned."""
    rows = docs.where(training_row(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", F.lit("language")).alias("h"))
    # Written, so that Spark knows its size, a row for each language, and texts need no shuffle.
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS), "languages")
    share = F.least(F.lit(1.0), PER_LANGUAGE / F.col("n"))
    sample = rows.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 20)) < share * float(1 << 20)).select("lang", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, t) for t in _TOKEN.findall(text.lower()))
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counted = sample.mapInArrow(tokens, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in counted.toPandas().itertuples(index=False):  # of the bounded sample
        counts.setdefault(lang, {})[word] = int(n)
    languages = sorted(counts)
    if not languages:
        return Model([], {}, {n: {} for n in ORDERS})
    grams = {}
    for order in ORDERS:
        by: dict[str, Counter] = {lang: Counter() for lang in languages}
        for lang in languages:
            for word, n in counts[lang].items():
                marked = f"^{word}$"
                for i in range(len(marked) - order + 1):
                    by[lang][marked[i : i + order]] += n
        grams[order] = _log_frequencies(by, languages, GRAMS)
    return Model(languages, _log_frequencies(counts, languages, WORDS), grams)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus lang_pred and lang_score (0 to 1); columns of those names are replaced.

    Text that is null or has no letter, or a model without languages: `und`, 0. Ties go to the first language
    in alphabetical order. The rows come as they are, repeated or not; only text is looked at.
    """
    docs = replaced(docs, "lang_pred", "lang_score")
    held = Held(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [m.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))
