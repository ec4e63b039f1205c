"""Operator 9: near-duplicates by SimHash, with pigeonring filtering.

Fingerprints are 64 bits in SEGMENTS segments, seen as a ring. If two differ in at most BITS bits, some segment
starts a chain in which, for every length l, the first l segments together differ in at most
l * BITS / SEGMENTS bits (pigeonring principle; the pigeonhole principle is the case l = 1). As that bound is
below one for the first RUN segments, these must be equal: each fingerprint is put under one key per start,
and only fingerprints under one key are compared, first over half a ring, then in full.

Equal fingerprints are one class from the start, so exact copies cost nothing. What a key yields is a spanning
forest of its links, not its pairs. A key with more than HOT fingerprints is not compared; its fingerprints go
a way that has no large groups: each is put under itself and its 64 neighbours at one bit, at most 65 can meet
at any of those, and two within two bits always do. Components are found by alternating large-star and
small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE, BITS, SEGMENTS, SEED = 3, 2, 8, 42
RUN = (SEGMENTS - 1) // BITS  # segments for which the chain's budget is below one bit
HOT = 1024
_SIZE = 64 // SEGMENTS
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def simhash(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the six separators
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    h, ones = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp), the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def chained(x: np.ndarray, start: int) -> np.ndarray:
    """Which of the differences x (xor of two fingerprints) keep within the budgets of the chain from start."""
    counts = _POP[x.view(np.uint8).reshape(len(x), SEGMENTS)].astype(np.int16)
    ring = np.cumsum(np.roll(counts, -start, axis=1), axis=1)
    ok = ring[:, SEGMENTS // 2 - 1] <= (SEGMENTS // 2) * BITS // SEGMENTS
    budget = np.arange(1, SEGMENTS + 1) * BITS // SEGMENTS
    ok[ok] = (ring[ok] <= budget).all(axis=1)
    return ok


def forest(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges (indices) of a spanning forest of the links among distinct fingerprints under one key."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(fp) - 1):
        for j in (np.flatnonzero(chained(fp[i] ^ fp[i + 1 :], start)) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> (u, v), links; v is null for a fingerprint under a hot key."""
    held_key, held, hot = None, [], False
    u: list[int] = []
    v: list[int | None] = []

    def close() -> None:
        if hot or sum(map(len, held)) < 2:
            return
        fp = np.concatenate(held)
        for i, j in forest(fp.view(np.uint64), held_key >> (RUN * _SIZE)):
            u.append(int(fp[i]))
            v.append(int(fp[j]))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u.clear()
        v.clear()
        return batch

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if keys[a] != held_key:
                close()
                held_key, held, hot = int(keys[a]), [], False
            part = fps[a:b]
            if not hot and sum(map(len, held)) + len(part) > HOT:
                hot = True
                part = np.concatenate([*held, part])
                held = []
            if hot:
                u.extend(part.tolist())
                v.extend([None] * len(part))
            else:
                held.append(part)
        yield out()
    close()
    yield out()


def links(classes: DataFrame) -> DataFrame:
    """classes(fp), distinct -> (u, v): enough links to connect all that are at most BITS bits apart."""
    segment = lambda s: F.shiftrightunsigned("fp", _SIZE * (s % SEGMENTS)).bitwiseAND((1 << _SIZE) - 1)
    key = lambda s: sum((F.shiftleft(segment(s + k), _SIZE * k) for k in range(RUN)), F.lit(s << (RUN * _SIZE)).cast("long"))
    keyed = classes.select(F.explode(F.array(*[key(s) for s in range(SEGMENTS)])).alias("key"), "fp")
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long"), "links")
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    hot = found.where("v is null").select(F.col("u").alias("fp")).distinct()
    met = hot.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("all")).where("size(all) > 1")  # 65 at most
    return found.where("v is not null").union(met.select(F.get("all", F.lit(0)).alias("u"), F.explode(F.expr("slice(all, 2, size(all))")).alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root): the least node of the component, for every node with an edge."""
    pairs = written(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct().select("u", "v"), "edges")
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        pairs = written(small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "small")
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id), a row per row.

    Ids are longs; others are cast, so one that is no number counts as null. component_id is the least doc_id reachable
    over links; null only if all ids of a component are. Texts
    that are null, empty or without words have fingerprint 0, linked like any other. Repeated rows stay.
    """
    fps = written(fingerprints(docs), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp")))
    tagged = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(tagged.select("fp", "root").join(ids, "root").select("fp", "component_id"), "components")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: the one whose doc_id is the component's id. Rows that
    share that id give one row, that of the least text hash; components without ids keep one row likewise."""
    near = near_duplicates(docs)
    out = [F.col(f"`{c}`") for c in docs.columns]
    drop = written(near.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct(), "dropped")
    kept = docs.join(drop, docs["doc_id"] == drop["__id"], "left_anti").select(*out)
    again = near.where("doc_id is null or doc_id = component_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not again:
        return kept
    # Repeated or null ids: rank rows of one id; null ids only stand if their component has no id.
    lone = near.where("component_id is null").select("fp").distinct()
    null_rows = kept.where("doc_id is null").withColumn("__fp", F.xxhash64("text"))
    marked = null_rows.mapInArrow(_with_fp(null_rows.columns), null_rows.schema).join(lone.withColumnRenamed("fp", "__fp"), "__fp").groupBy("__fp").agg(F.min(F.struct(*out)).alias("__r")).select("__r.*") if not lone.isEmpty() else kept.limit(0)
    rest = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*out), F.xxhash64("text")).alias("__r")).select("__r.*")
    return rest.unionByName(marked.select(*out))


def _with_fp(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t) for t in batch.column(names.index("text")).to_pylist()], np.uint64).view(np.int64)
            yield batch.set_column(names.index("__fp"), "__fp", pa.array(fp))

    return run
