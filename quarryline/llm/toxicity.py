"""Operator 6: toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled training rows, PER_CLASS of each class, chosen by a hash of the id. A
text is the TF-IDF vector of all its words that stand in any example, each weighted besides by how much its
document frequency in the examples depends on the class (square root of the G2 statistic): plain TF-IDF is about
the subject, and finds but a part of the toxic texts. Neighbours are the NEIGHBOURS examples of greatest cosine,
found exactly. Postings are cut into blocks of neighbouring examples with the greatest weight of each word, so a
block's maxima bound its cosines: the blocks of the greatest bounds are scored first, then all whose bounds reach the
neighbours found. The few words that stand in a large share of the examples have postings almost everywhere; their
lists are rows of a matrix, which is multiplied with a batch of texts at once. Near copies of one label are one example, weighted by their number. Votes are weighted by the cosine and by
how many labelled rows an example stands for, and shrunk a little towards the base, which texts without known words
get: the share of toxic rows, less what the absence of all significantly toxic words tells against it. The neighbours
are the evidence.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Held, replaced, training_row

PER_CLASS = 3000
#: Near copies: word sets this alike. Two that are share a band with a probability of 0.985 at 0.8 and 0.9998 at 0.9.
LIKE, BANDS, BAND_ROWS, SKETCH = 0.8, 8, 4, 512
#: FIRST blocks are scored before their result bounds the others. A word in more than FREQUENT of the examples is a row
#: of the matrix; texts meet it BATCH at a time (always as many, so that equal texts get equal results).
NEIGHBOURS, SHRINK, BLOCK, FIRST, FREQUENT, BATCH = 30, 1.0, 64, 6, 0.05, 64
#: G2 from which a word's absence counts in the base.
SIGNIFICANT = 15.0
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """The words of a text (runs of letters, in lower case) and how often each occurs."""
    return Counter(_TOKEN.findall((text or "").lower()))


def _hashes(words: Counter) -> np.ndarray:
    """Hashes of a text's words, each once, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)))


def _bands(h: np.ndarray) -> list[bytes]:
    """BANDS signatures of BAND_ROWS min-hashes each, every one by a hash of its own (the finalizer of splitmix64)."""
    mins = []
    for k in range(1, BANDS * BAND_ROWS + 1):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mins.append((x ^ (x >> np.uint64(31))).min())
    return [np.array(mins[i : i + BAND_ROWS]).tobytes() for i in range(0, len(mins), BAND_ROWS)]


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two word sets by their SKETCH least hashes: exact for up to SKETCH words in both together."""
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).mean())


def group_copies(rows: list[tuple[int, int, list[bytes], np.ndarray]]) -> dict[int, int]:
    """rows (doc_id, label, bands, sketch) -> size of its group of near copies for each example to keep.

    In the order of ids, a row joins the most alike kept row of its own label (of equals the first) if their word sets
    are at least LIKE alike; otherwise it is kept. Only kept rows attract others. Texts without words are kept.
    """
    size: dict[int, int] = {}
    kept: list[tuple[int, np.ndarray]] = []
    by_band: dict[tuple[int, int, bytes], list[int]] = {}
    for doc_id, y, bands, sketch in sorted(rows, key=lambda r: (r[0], r[1])):
        if doc_id in size:  # a repeated id
            continue
        keys = [(y, i, x) for i, x in enumerate(bands)]
        near = sorted({e for k in keys for e in by_band.get(k, ())})
        like, e = max(((_likeness(sketch, kept[e][1]), -e) for e in near), default=(0.0, 0))
        if like >= LIKE:
            size[kept[-e][0]] += 1
            continue
        for k in keys:
            by_band.setdefault(k, []).append(len(kept))
        kept.append((doc_id, sketch))
        size[doc_id] = 1
    return size


def relevance(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """G2 of the words that stand in pos of n_pos toxic examples and in neg of n_neg others, half a document added to each
    count so that no word has none."""
    a, b, p, n = pos + 0.5, neg + 0.5, n_pos + 1.0, n_neg + 1.0
    share = (a + b) / (p + n)
    part = lambda x, of: x * np.log(x / (of * share)) + (of - x) * np.log((of - x) / (of * (1 - share)))
    return 2 * np.maximum(part(a, p) + part(b, n), 0)


def weights(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, per_row: tuple[float, float]) -> np.ndarray:
    """IDF times the root of the relevance. IDF counts rows that the examples stand for: per_row of the others, of the toxic ones."""
    rows = n_neg * per_row[0] + n_pos * per_row[1]
    idf = np.log((rows + 1) / (neg * per_row[0] + pos * per_row[1]))
    return np.maximum(idf, 1e-6) * np.sqrt(np.maximum(relevance(pos, neg, n_pos, n_neg), 1e-6))


def base_rate(share: float, pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> float:
    """The share of toxic rows among texts that lack all words which are significantly commoner in toxic ones (taken as
    independent of each other)."""
    a, b = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    told = (relevance(pos, neg, n_pos, n_neg) >= SIGNIFICANT) & (a > b)
    odds = share / (1 - share) * math.exp(float(np.log((1 - a[told]) / (1 - b[told])).sum()))
    return odds / (1 + odds)


class Index:
    """Inverted lists over example vectors, in blocks of neighbouring examples with block maxima.

    Entries (word, block) lie in order of words: word t has the entries of_term[t] to of_term[t + 1]. Entry i has the
    postings cut[i] to cut[i + 1] and the greatest weight top[i]. Frequent words have none, but the row[t] of the matrix.
    """

    def __init__(self, doc_ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, words: pa.ListArray, counts: np.ndarray, share: float, per_row: tuple[float, float] = (1.0, 1.0)) -> None:
        """Examples: ids, labels, rows that each stands for, its words and, in their order, counts; share: of toxic rows;
        per_row: rows that one sampled row of label 0, 1 stands for."""
        encoded = words.flatten().dictionary_encode()
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        self.words = encoded.dictionary.take(pa.array(order)).to_pylist()
        term = np.argsort(order)[encoded.indices.to_numpy()]
        size = np.diff(words.offsets.to_numpy())
        example, toxic = np.repeat(np.arange(len(size)), size), labels == 1
        of = lambda weight: np.array([np.bincount(term[pick], weight[example[pick]], len(self.words)) for pick in (~toxic[example], toxic[example])])
        df, n = of(np.ones(len(size))), [int(((size > 0) & (toxic == y)).sum()) for y in (False, True)]
        self.weight = weights(df[1], df[0], n[1], n[0], per_row)
        self.base = share
        if 0 < share < 1:  # by sampled rows, copies included: where these are few groups, rows are what there is to learn from
            copies = rows / np.where(toxic, per_row[1], per_row[0])
            seen = of(copies)
            all_ = [copies[(size > 0) & (toxic == y)].sum() for y in (False, True)]
            self.base = base_rate(share, seen[1], seen[0], all_[1], all_[0])
        value = (1 + np.log(counts)) * self.weight[term]
        value = value / np.sqrt(np.bincount(example, value * value, len(size)))[example]
        # Alike examples side by side, so that blocks have tight bounds: by label, then the heaviest word.
        heaviest = np.lexsort((term, -value, example))
        first = heaviest[np.flatnonzero(np.diff(example[heaviest], prepend=-1))]
        with_words = np.flatnonzero(size > 0)
        ranked = with_words[np.lexsort((doc_ids[with_words], -value[first], term[first], labels[with_words]))]
        place = np.full(len(size), -1, np.int32)
        place[ranked] = np.arange(len(ranked), dtype=np.int32)
        at = place[example]
        self.doc_ids, self.labels, self.rows = doc_ids[ranked].astype(np.int64), labels[ranked].astype(float), rows[ranked].astype(float)
        self.per_row = np.where(self.labels > 0, per_row[1], per_row[0])
        n = len(ranked)
        self.blocks = -(-n // BLOCK)
        frequent = np.flatnonzero(df.sum(0) > max(BLOCK, FREQUENT * n))
        self.row = np.full(len(self.words), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.blocks * BLOCK))
        often = self.row[term] >= 0
        self.matrix[self.row[term[often]], at[often]] = value[often]
        order = np.lexsort((at, term))
        order = order[~often[order]]
        term, self.at, self.value = term[order], at[order], value[order]
        entry = np.flatnonzero(np.diff(term * max(1, self.blocks) + self.at // BLOCK, prepend=-1))
        self.cut = np.append(entry, len(term))
        self.top = np.maximum.reduceat(self.value, entry) if len(entry) else np.zeros(0)
        self.block_of = self.at[entry] // BLOCK
        self.of_term = np.searchsorted(term[entry], np.arange(len(self.words) + 1))

    def __getstate__(self) -> dict:
        return {k: pa.array(v) if k == "words" else v for k, v in self.__dict__.items() if k != "ids"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"words": state["words"].to_pylist()})

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known words of a text, in order, and their weights, of length 1; both empty if there are none."""
        if "ids" not in self.__dict__:
            self.ids = {w: i for i, w in enumerate(self.words)}
        t = np.fromiter(map(self.ids.get, counts, itertools.repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))[t >= 0]
        t = t[t >= 0]
        if not len(t):
            return t, n
        order = np.argsort(t)
        t = t[order]
        v = (1 + np.log(n[order])) * self.weight[t]
        return t, v / np.linalg.norm(v)

    def nearest(self, texts: list[dict[str, int]], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text (its words' counts) the k greatest cosines above 0 (to 12 places) and their examples, of equal
        cosines the first examples."""
        for i in range(0, len(texts), BATCH):
            vectors = [self.vector(c) for c in texts[i : i + BATCH]]
            query = np.zeros((BATCH, len(self.matrix)))
            for q, (t, w) in zip(query, vectors, strict=False):
                r = self.row[t]
                q[r[r >= 0]] = w[r >= 0]
            for scores, (t, w) in zip(query @ self.matrix, vectors, strict=False):
                rare = self.row[t] < 0
                yield self._finish(scores, t[rare], w[rare], k)

    def _finish(self, scores: np.ndarray, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """scores: what frequent words give each example; t, w: the others."""
        n = self.of_term[t + 1] - self.of_term[t]
        entries, by = _ranges(self.of_term[t], n), np.repeat(w, n)  # each (word, block) with the text's weight of the word
        block = self.block_of[entries]
        bounds = np.bincount(block, by * self.top[entries], self.blocks) + scores.reshape(-1, BLOCK).max(1)
        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        self._add(scores, entries[first[block]], by[first[block]])
        whole = np.repeat(first, BLOCK)
        known = scores[whole]
        reached = np.partition(known, -k)[-k] if len(known) > k else 0.0
        rest = ~first & (bounds >= max(reached - 1e-9, 1e-12))
        self._add(scores, entries[rest[block]], by[rest[block]])
        found = np.flatnonzero(np.repeat(first | rest, BLOCK) & (scores >= max(reached - 1e-9, 1e-12)))
        cosines = np.round(scores[found], 12)
        best = np.argsort(-cosines, kind="stable")[:k]
        return cosines[best], found[best]

    def _add(self, scores: np.ndarray, entries: np.ndarray, by: np.ndarray) -> None:
        n = self.cut[entries + 1] - self.cut[entries]
        p = _ranges(self.cut[entries], n)
        scores += np.bincount(self.at[p], self.value[p] * np.repeat(by, n), len(scores))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Score and evidence of each text."""
        out = []
        for cosines, e in self.nearest([terms(t) for t in texts]):
            if not len(e):
                out.append((self.base, []))
                continue
            votes = cosines * self.rows[e]
            shrink = SHRINK * self.per_row[e].mean()
            score = (votes @ self.labels[e] + shrink * self.base) / (votes.sum() + shrink)
            out.append((float(min(1.0, max(0.0, score))), self.doc_ids[e].tolist()))
        return out


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """docs(doc_id, text), labels(doc_id, toxic): only training rows count; an id with both labels is toxic."""
    marks = labels.where(training_row(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        none = np.zeros(0)
        return Index(none, none, none, pa.array([], pa.list_(pa.string())), none, float(bool(sizes.get(1))))
    share = {y: min(1.0, PER_CLASS / n) for y, n in sizes.items()}
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * float(1 << 20)
    # About 2 * PER_CLASS ids: a bounded broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(marks.where(chosen)), "doc_id").select(F.col("doc_id").cast("long"), "y", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = terms(text)
                h = _hashes(c)
                row = {"doc_id": doc_id, "y": y, "bands": _bands(h) if len(h) else [], "sketch": h[:SKETCH].tobytes(), "words": list(c), "counts": list(c.values())}
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("bands", pa.list_(pa.binary())), ("sketch", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    got = sample.mapInArrow(read, "doc_id long, y int, bands array<binary>, sketch binary, words array<string>, counts array<long>").toArrow()  # the bounded sample
    got = got.combine_chunks()
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy()
    # One example of each group of near copies: their common words are no signs of anything.
    copies = group_copies([(int(d), int(k), b.as_py(), np.frombuffer(s.as_py(), np.uint64)) for d, k, b, s in zip(ids, y, got["bands"], got["sketch"], strict=True)])
    first = {int(d): i for i, d in reversed(list(enumerate(ids))) if int(d) in copies}  # of a repeated id the first row
    kept = np.array(sorted(first.values(), key=lambda i: ids[i]), np.int64)
    words = got["words"].chunk(0).take(pa.array(kept)) if len(kept) else pa.array([], pa.list_(pa.string()))
    counts = got["counts"].chunk(0).take(pa.array(kept)).flatten().to_numpy() if len(kept) else np.zeros(0)
    rows = np.array([copies[int(ids[i])] / share[int(y[i])] for i in kept])
    return Index(ids[kept], y[kept], rows, words, counts, sizes[1] / (sizes[0] + sizes[1]), (1 / share[0], 1 / share[1]))


def rate(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """docs plus toxicity (0 to 1) and evidence (doc_ids of the neighbours, nearest first); columns of those names are
    replaced.

    Null and empty texts, and those without a known word, get the index's base and no evidence. Only text is
    looked at; equal texts get equal scores; rows come as they are, repeated or not. Without labels of both classes
    nothing can be learned: the score is then the one class seen, or 0.
    """
    docs = replaced(docs, "toxicity", "evidence")
    held = Held(docs.sparkSession, index)  # of PER_CLASS examples
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                got = m.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], [*part.schema.names, "toxicity", "evidence"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxicity", DoubleType()), StructField("evidence", ArrayType(LongType()))]))
