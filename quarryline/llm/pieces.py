"""Operator 3: SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words where no piece can span: before runs of spaces and before line ends; a longer stretch also
at characters that stand in no piece of several characters. Documents lie in chunks of neighbouring rows, and each
chunk sends its distinct words to the tasks that have those words. There every distinct word of the corpus is
encoded once: its substrings up to the longest piece are exploded, equi-joined to the piece table (of fixed size, so
broadcast) and grouped by word into a lattice, and aggregate() folds the lattice into the segmentation. Segmentations
go back to their chunks by a join on the word, and are written as a table with a folder for each chunk, from which the
task that encodes a chunk reads its dictionary. No task holds more than a chunk's words, and nothing that is broadcast
grows with the data. Words of more than LONG characters alone are folded where they are read, by the same rule with a
heap, as the fold over a lattice copies its state at each merge.

The fold is the model's own rule. For a unigram model that is Viterbi, the path of the greatest sum of scores.
The model at hand is a BPE model, whose library merges the best-scored adjacent pair until none is left; the
path of the greatest sum is another one for many words, so there the fold merges. As no piece is scored above
the pieces it is made of (load() makes sure), one pass over the edges by score, then place, does all merges.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import Held, filesystem, free, replaced, shared_dir, tidy, written

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text to a chunk, on average, and to a slice that a task encodes at once.
CHUNK_BYTES, SLICE_BYTES = 20 << 20, 1 << 21
#: A stretch of more characters is cut further; a word of more is no lattice.
STRETCH, LONG = 64, 500
SPACE = "▁"
_NORMAL, _BYTE = 1, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    raw: list[bytes]  # by id, what it decodes to
    cut: str = ""  # pattern of words
    longest: int = 1

    def segment(self, word: str) -> list[str]:
        """The pieces and single characters of a word by the model's rule."""
        return self._merge(word) if self.kind == BPE else self._best_path(word)

    def of(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character that is none."""
        return [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]

    def _merge(self, word: str) -> list[str]:
        """Merges the pair of the best score, of equals the leftmost, until no pair is a piece."""
        s: list[str | None] = list(word)
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and right[i] < len(s) and (x := self.scores.get(pair := s[i] + s[right[i]])) is not None:
                heapq.heappush(heap, (-x, i, pair))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if s[i] is None or right[i] >= len(s) or s[i] + s[right[i]] != pair:
                continue
            j = right[i]
            s[i], s[j] = pair, None
            right[i] = right[j]
            if right[i] < len(s):
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [x for x in s if x is not None]

    def _best_path(self, word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            best.append(max((best[i][0] + self.scores.get(word[i:j], UNKNOWN if j == i + 1 else -1e300), i) for i in range(max(0, j - self.longest), j)))
        out, j = [], len(word)
        while j:
            out.append(word[best[j][1] : j])
            j = best[j][1]
        return out[::-1]


#: Score of a character that is no piece.
UNKNOWN = -1e12


def _in_order(model: Model) -> bool:
    """Whether each piece that merging can reach is scored below the pieces it is merged from."""
    for piece, score in model.scores.items():
        if len(piece) > 2:
            s = list(piece)
            while len(s) > 1:
                pairs = [(-model.scores[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in model.scores]
                if not pairs:
                    break
                x, i = min(pairs)
                s[i : i + 2] = [s[i] + s[i + 1]]
                if len(s) > 1 and -x < score:
                    x = None
                    break
            else:
                continue
            if x is None and model._merge(piece) == [piece]:
                return False
    return True


def load(path: str = DEFAULT_MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("only models without normalisation and with a leading space are supported")
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == _BYTE]
    raw = [bytes([byte_ids.index(i)]) if p.type == _BYTE else p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else b"" for i, p in enumerate(proto.pieces)]
    if any(SPACE in p.lstrip(SPACE) or " " in p or "\n" in p[1:] or "\n" in p and len(p) > 1 for p in ids) or len(byte_ids) != 256:
        raise ValueError("only models whose pieces have spaces in front, no line ends, and that fall back to bytes are supported")
    inner = sorted({c for p in ids if len(p) > 1 for c in p} - {SPACE})
    letters = "[" + "".join(f"\\u{ord(c):04X}" if ord(c) < 65536 else f"\\U{ord(c):08X}" for c in inner) + "]"
    cut = f"{SPACE}+{letters}*|{letters}+|(?s:.)"
    model = Model(proto.trainer_spec.model_type, ids, {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}, byte_ids, raw, cut, max(map(len, ids)))
    if model.kind == BPE and not _in_order(model):
        raise ValueError("only BPE models whose pieces are scored below their parts are supported")
    return model


class Cutter:
    """Cuts texts into words, named by keys: what follows the space for a word with one in front, the word itself if it
    starts with a line end, and two line ends and the word for any other. That is what split() gives, at its speed."""

    def __init__(self, cut: str) -> None:
        self.stretches = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*").findall
        self.fine = re.compile(cut).findall

    def keys(self, text: str) -> list[str]:
        if not text:
            return []
        out = text.replace("\n", " \n").split(" ")
        if "" in out or SPACE in text:  # runs of spaces, which stay together
            out = [key(w) for w in self.stretches(SPACE + text.replace(" ", SPACE))]
        if len(max(out, key=len)) > STRETCH:
            out = [k for o in out for k in ([o] if len(o) <= STRETCH else map(key, self.fine(word(o))))]
        return out


def key(w: str) -> str:
    return w[1:] if w[0] == SPACE else w if w[0] == "\n" else "\n\n" + w


def word(k: str) -> str:
    return k[2:] if k[:2] == "\n\n" else k if k[:1] == "\n" else SPACE + k


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """words(word), distinct -> (word, edges): the pieces at places a to b of the word; words without any are left out.

    For BPE edges are numbers that sort by score, then place: (rank << 20) + (a << 10) + b, of pieces of two
    characters and more. For unigram models they are array<struct<a, b, score>>. Words have at most LONG characters.
    """
    least = 2 if model.kind == BPE else 1
    ranked = sorted((p for p in model.ids if len(p) >= least), key=lambda p: (-model.scores[p], model.ids[p]))
    table = words.sparkSession.createDataFrame(pa.table({"piece": ranked, "rank": pa.array(range(len(ranked)), pa.int64()), "score": [model.scores[p] for p in ranked]}))
    spans = words.select("word", F.length("word").alias("n")).where(f"n >= {least}").select("word", "n", F.explode(F.expr(f"sequence(0, n - {least})")).alias("a"))
    spans = spans.select("word", "a", F.explode(F.expr(f"sequence(a + {least}, least(a + {model.longest}, n))")).alias("b"))
    spans = spans.select("word", "a", "b", F.expr("substring(word, a + 1, b - a)").alias("piece"))
    edge = F.expr("shiftleft(rank, 20) + shiftleft(a, 10) + b") if model.kind == BPE else F.struct("a", "b", "score")
    edges = spans.join(F.broadcast(table), "piece")  # of fixed size: the model's vocabulary
    return edges.select("word", edge.alias("edge")).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def fold(lattices: DataFrame, kind: int) -> DataFrame:
    """(word, edges) -> (word, pieces): the segmentation, its pieces joined by spaces (a word has none, but for marks)."""
    if kind == BPE:
        # s: for each place the end of the symbol that starts there, -1 if none does. An edge that spans two symbols merges them.
        a, b = "cast(shiftright(e, 10) & 1023 as int)", "cast(e & 1023 as int)"
        merged = f"transform(s, (x, i) -> if(i = {a}, {b}, if(i = get(s, {a}), -1, x)))"
        ends = f"aggregate(edges, sequence(1, length(word)), (s, e) -> if(get(s, get(s, {a})) = {b}, {merged}, s))"
        return lattices.select("word", F.expr(ends).alias("ends")).select("word", F.expr("array_join(transform(ends, (x, i) -> if(x > 0, substring(word, i + 1, x - i), null)), ' ')").alias("pieces"))
    # Viterbi: at each end the best sum and where its last piece starts; a character that is no piece costs much.
    best = f"array_max(transform(concat(filter(edges, x -> x.b = j), array(struct(j - 1 as a, j as b, {UNKNOWN:.0f}D as score))), x -> struct(get(v, x.a).s + x.score as s, x.a as a)))"
    forward = f"aggregate(sequence(1, length(word)), array(struct(0D as s, 0 as a)), (v, j) -> concat(v, array({best})))"
    back = "aggregate(sequence(1, length(word)), array(length(word)), (c, k) -> if(get(c, 0) = 0, c, concat(array(get(v, get(c, 0)).a), c)))"
    cuts = lattices.select("word", F.expr(forward).alias("v")).select("word", F.expr(back).alias("c"))
    return cuts.select("word", F.expr("array_join(transform(slice(c, 2, size(c)), (x, i) -> substring(word, get(c, i) + 1, x - get(c, i))), ' ')").alias("pieces"))


def _keys_of_chunks(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(chunk, text) -> (chunk, key): the keys of all words, each once for a run of one chunk's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen, at = Cutter(pattern).keys, set(), None

        def rows() -> Iterator[pa.RecordBatch]:
            keys = sorted(seen)  # neighbours share their beginnings, which compresses
            seen.clear()
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at, np.int64)), pa.array(part, pa.string())], ["chunk", "key"])

        for batch in batches:
            for chunk, part in _runs(batch, 0):
                if chunk != at:
                    yield from rows()
                    at = chunk
                for s in _slices(part.column(1)):
                    for t in s.to_pylist():
                        if t:
                            seen.update(cut(t))
        yield from rows()
        tidy()

    return run


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The parts of a batch that lie in one chunk each."""
    chunks = batch.column(column).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(chunks[a]), batch.slice(a, b - a)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts of about SLICE_BYTES, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 16)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield texts.slice(i, j - i)
        i = j


def _chunked(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """docs with a column, named in the result, that says which chunk a row is in: neighbours in a file. Rows that
    aren't read from Parquet in its order are written first."""
    name = free("__chunk", docs.columns)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    try:
        if re.search(r"^[\s:+-]*(Join|Aggregate|Sort|Repartition\w*|Window|Generate|LogicalRDD)\b", plan, re.MULTILINE):
            raise AnalysisException("rows are not in the order of files")
        place = docs.metadataColumn("_metadata")
        place["row_index"], docs.select(place["row_index"])
    except AnalysisException:
        docs = written(docs, "texts")
        place = docs.metadataColumn("_metadata")
    mean = docs.agg(F.avg(F.octet_length(F.col(f"`{text}`")))).first()[0]
    rows = max(1, int(CHUNK_BYTES / max(1.0, mean or 0.0)))
    return docs.withColumn(name, F.xxhash64(place["file_path"], F.floor(place["row_index"] / rows))), name


def dictionaries(chunked: DataFrame, model: Model, text: str, chunk: str) -> str:
    """Writes (chunk, pieces): the segmented words of each chunk, in a folder of its own. Returns the table's path."""
    spark = chunked.sparkSession
    path = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    pairs = chunked.select(F.col(chunk).alias("chunk"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_keys_of_chunks(model.cut), "chunk long, key string")
    pairs = pairs.select("chunk", F.expr(f"case when startswith(key, '\\n\\n') then substring(key, 3) when startswith(key, '\\n') then key else concat('{SPACE}', key) end").alias("word"))
    pairs = pairs.where(f"length(word) between 2 and {LONG}").repartition("word")
    # The condition keeps the chunk in this side's rows too, so that both sides are one exchange, made once.
    words = pairs.groupBy("word").agg(F.min("chunk").alias("some")).where("some is not null").select("word")
    segmented = fold(lattice(words, model), model.kind)
    # A word has one row for each chunk that it is in, so no key stands out, however common the word.
    found = pairs.join(segmented, "word", "left").select("chunk", F.coalesce("pieces", F.array_join(F.split("word", ""), " ")).alias("pieces"))
    found.repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path


class _Dictionary(dict):
    """Places of words, by key, in a table of ids: those of a chunk, and characters and very long words as they come.

    A key enters on its first use, so that the common ones, which come early, lie together in memory.
    """

    def __init__(self, model: Model, files, path: str) -> None:
        super().__init__()
        self.model, self.more = model, []
        try:
            pieces = pq.read_table(path, columns=["pieces"], filesystem=files, partitioning=None)["pieces"].combine_chunks()
        except FileNotFoundError:
            pieces = pa.array([], pa.string())
        pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
        self.rest = {key(w): i for i, w in enumerate(pc.replace_substring(pieces, " ", "").to_pylist())}
        lists = pc.split_pattern(pieces, " ")
        parts = lists.flatten()
        known = pa.array(list(model.ids), pa.string())
        at = pc.fill_null(pc.index_in(parts, value_set=known), -1).to_numpy()
        ids = np.fromiter(model.ids.values(), np.int32, len(model.ids))[at]
        size = np.ones(len(at), np.int64)
        if len(odd := np.flatnonzero(at < 0)):  # characters that are no piece
            of = [model.of(c) for c in parts.take(pa.array(odd)).to_pylist()]
            size[odd] = [len(x) for x in of]
            ids = np.repeat(ids, size)
            ids[np.concatenate([np.arange(e - n, e) for e, n in zip(np.cumsum(size)[odd].tolist(), size[odd].tolist(), strict=True)])] = [i for x in of for i in x]
        self.flat = ids
        self.ends = np.concatenate(([0], np.cumsum(size)))[lists.offsets.to_numpy()] if len(lists) else np.zeros(1, np.int64)

    def __missing__(self, k: str) -> int:
        if (place := self.rest.pop(k, None)) is None:
            w = word(k)
            if 1 < len(w) <= LONG:
                raise KeyError(f"a word that its chunk's dictionary lacks: {w}")
            self.more.append(np.array([i for s in self.model.segment(w) for i in self.model.of(s)], np.int32))
            place = len(self.ends) + len(self.more) - 2
        self[k] = place
        return place

    def ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and after each word the number of ids so far."""
        at = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.more:
            self.flat = np.concatenate([self.flat, *self.more])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(m) for m in self.more])])
            self.more = []
        size = self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.ends[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Encodes the texts of chunks, whose dictionaries lie below path. Holds one chunk's dictionary."""

    def __init__(self, model: Model, path: str) -> None:
        self.model, self.cut, self.chunk = model, Cutter(model.cut).keys, None
        self.files, self.path = filesystem(path)

    def batch(self, chunk: int, texts: pa.Array) -> pa.ListArray:
        if chunk != self.chunk:
            self.words = None  # let go of one before the next is read
            self.words, self.chunk = _Dictionary(self.model, self.files, f"{self.path}/chunk={chunk}"), chunk
        keys: list[str] = []
        ends = [0]
        for t in texts.to_pylist():
            if t:
                keys += self.cut(t)
            ends.append(len(keys))
        ids, after = self.words.ids(keys)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], after))[ends].astype(np.int32)), pa.array(ids, pa.int32()))


class Decoder:
    """Bytes of all ids are gathered by one index; a text's leading space is not copied."""

    def __init__(self, model: Model) -> None:
        self.table = np.frombuffer(b"".join(model.raw), np.uint8)
        self.size = np.array([len(x) for x in model.raw])
        self.begin = np.cumsum(self.size) - self.size

    def batch(self, col: pa.ListArray) -> pa.Array:
        off = col.offsets.to_numpy().astype(np.int64)
        i = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
        n, src = self.size[i], self.begin[i]
        heads = (off[:-1] - off[0])[np.diff(off) > 0]
        spaced = heads[self.table[src[heads]] == 32] if len(heads) else heads
        n[spaced] -= 1
        src[spaced] += 1
        ends = np.concatenate(([0], np.cumsum(n)))
        out = self.table[np.repeat(src - ends[:-1], n) + np.arange(ends[-1])]
        got = pa.Array.from_buffers(pa.string(), len(col), [None, pa.py_buffer(ends[off - off[0]].astype(np.int32)), pa.py_buffer(out)])
        try:
            got.validate(full=True)
        except pa.ArrowInvalid:  # ids that don't come from a text
            starts = ends[off - off[0]]
            got = pa.array([out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, starts[1:], strict=False)], pa.string())
        return pc.if_else(col.is_valid(), got, pa.scalar(None, pa.string()))


def _over_chunks(docs: DataFrame, model: Model, text: str, keep: list[str], fields: list[StructField], work: Callable) -> DataFrame:
    """The columns to keep and those that work(encoder, decoder, chunk, texts) gives for a slice of rows."""
    spark: SparkSession = docs.sparkSession
    rows, chunk = _chunked(docs, text)
    path = dictionaries(rows, model, text, chunk)
    held = Held(spark, model)  # of fixed size
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(chunk), F.col(f"`{text}`").cast("string").alias(free("__text", [*keep, chunk])))
    at, names = len(keep), [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(held.value, path), Decoder(held.value)
        for batch in batches:
            for chunk_, part in _runs(batch, at):
                i = 0
                for texts in _slices(part.column(at + 1)):
                    rest = part.slice(i, len(texts)).columns[:at]
                    i += len(texts)
                    yield pa.RecordBatch.from_arrays([*rest, *work(encoder, decoder, chunk_, texts)], names)
        encoder = None
        tidy()

    return rows.mapInArrow(run, StructType([*rows.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *fields]))


def encode(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus token_ids, array<int>, as the model's library gives them; a column of that name is replaced.

    Null and empty texts have no tokens. Characters that are no piece become their UTF-8 bytes' pieces. Rows
    come as they are, repeated or not, with their other columns, whatever the names; no rows, none out.
    """
    docs = replaced(docs, "token_ids")
    return _over_chunks(docs, model, text, docs.columns, [StructField("token_ids", ArrayType(IntegerType()))], lambda e, d, chunk, texts: [e.batch(chunk, texts)])


def round_trip(docs: DataFrame, model: Model, text: str, *keep: str) -> DataFrame:
    """The columns to keep, n_tokens, token_ids and round_trip: whether decoding gives the text back (null: empty)."""

    def work(e: Encoder, d: Decoder, chunk: int, texts: pa.Array) -> list[pa.Array]:
        ids = e.batch(chunk, texts)
        return [pc.list_value_length(ids).cast(pa.int64()), ids, pc.equal(d.batch(ids), pc.fill_null(texts, ""))]

    fields = [StructField("n_tokens", LongType()), StructField("token_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    return _over_chunks(docs, model, text, list(keep), fields, work)


def decode(tokens: DataFrame, model: Model, ids: str = "token_ids") -> DataFrame:
    """tokens plus decoded, the text: the leading space that encoding adds is taken off. Null ids: null. A column
    decoded is replaced."""
    tokens = replaced(tokens, "decoded")
    at, held = tokens.columns.index(ids), Held(tokens.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            step = max(1, int(batch.num_rows * (SLICE_BYTES // 4) / max(1, len(batch.column(at).values))))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.batch(part.column(at))], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", StringType())]))
