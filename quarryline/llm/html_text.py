"""Operator 2: main text of HTML pages, by marks and by a suffix array of each host.

A page is parsed once into blocks of text. Scripts, navigation, headers, footers, asides and forms go by element,
adverts, notices, reader comments and the like by the names of containers. The token streams of what is left of all of
a host's pages, with block ends as tokens, are put together; their suffixes are dealt out by host and first RUN tokens,
sorted, and neighbours from pages of different contents compared. The stretches that they share are repeated. Then
regions, that is the body and its article and main elements, compete by the amount of their text, in which repeated
text counts a REPEATED-th: a region within that has over two thirds of it is entered; one whose own text outweighs the
regions within is the story with teasers, which go. Where no region was entered, the tokens of the repeated stretches
are removed, and the unique runs stay.

All suffixes that share RUN tokens meet in one task, in order. Those of one part of the pages that several of its pages
have to their full depth know all they can share there; one of them meets the other parts' in their place, so a window
has about one row for each part, however large the host, and pages of equal contents count once. Only suffixes whose
first RUN tokens stand on a second page are dealt out: before, hashes of all windows, of as many bits as their number
asks for, are brought together in sorted blocks, and each block is told which of its hashes were met elsewhere. Hashes
that clash let a few others through as well, one in 2**SPARE, but none that repeats is left out.

Texts are written once and nowhere shuffled: what concerns a part of them (first pages of their contents, repeated
windows, stretches) is written by part, and tasks that read the texts read it beside them.

Repetition alone would be wrong here: menus, adverts and footers that differ from page to page would stay, and
passages that several articles share would go. So an article that was entered keeps them.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import itertools
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, written

#: Tokens that a repeated stretch has at least, and to which suffixes are compared.
RUN, DEPTH = 8, 24
#: Repeated text counts so many times less. Characters and pages that are hashed, suffixes that are dealt out at once.
REPEATED, CHARS, PAGES, SUFFIXES = 4, 1 << 23, 1 << 16, 1 << 17
#: Bits of a window's hash beyond those that number all windows: of windows that nothing repeats, one in 2**SPARE passes for repeated.
SPARE = 8
# HTML element names, and words of class and id names and roles that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea input svg math iframe object canvas audio video map menu dialog datalist".split())
MARKS = frozenset("ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice newsletter subscribe signup popup modal overlay comment comments disqus respond replies share sharing social related recommended toolbar pagination pager login search skip widget".split())
#: Words that may stand beside marks in a name that marks; any other word makes it a name of something else.
BESIDE = frozenset("area bar block bottom box container content fixed form global group inner item left list links main outer page panel post right row section site slot sticky thread top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Elements whose names count; a paragraph or a word may be called what it likes.
CONTAINERS = frozenset("article aside center details div dl fieldset figure ol section table ul".split())
REGIONS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag of the given kind ends if they are open.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("article main section div body table ul ol dl nav aside header footer form blockquote".split())


@functools.lru_cache(4096)
def marked(names: str) -> bool:
    """Whether one of the class or id names says that an element is no part of the article."""
    return any((words := re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())) and not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words) for name in names.split())


@dataclass(slots=True)
class _Element:
    tag: str
    gone: bool  # by itself or an element around it, whatever it holds
    region: int
    names: tuple[int, ...] = ()  # elements around it, itself included, that names mark: void if a region is within
    headings: bool = False  # the header of a region: only headings count


class _Page(HTMLParser):
    """Blocks of text, each with its region and the elements around it that names mark. Work per tag is constant."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = [_Element("", False, 0)]
        self.places: dict[str, list[int]] = {}  # of open elements, by tag
        self.scopes: list[int] = []
        self.parents = [0]  # of regions
        self.named = 0
        self.void: set[int] = set()
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.parts: list[str] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            self.blocks.append((text, self.open[-1].region, self.open[-1].names))

    def _pop(self, n: int) -> None:
        while len(self.open) > n:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()

    def _last(self, tags: tuple[str, ...]) -> int:
        """Place of the last open element of the tags, if no scope begins after it; else 0."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        return at if not self.scopes or at >= self.scopes[-1] else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if ends := _CLOSES.get(tag):
            if at := self._last(ends):
                self._pop(at)
        elif tag not in INLINE and (at := self._last(("p",))) and at >= len(self.open) - 3:
            self._pop(at)
        around = self.open[-1]
        a = {k: v or "" for k, v in attrs}
        region, names, headings = around.region, around.names, around.headings
        gone = around.gone or tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES
        if tag == "header" and region and not around.gone and not headings:
            gone, headings = False, True
        if a and tag in CONTAINERS and marked(f"{a.get('class', '')} {a.get('id', '')}"):
            self.named += 1
            names = (*names, self.named)
        elif not gone and (tag in REGIONS or a.get("role", "").lower() == "main" or "articlebody" in a.get("itemprop", "").lower()):
            self.parents.append(region)
            region = len(self.parents) - 1
            if len(around.names) == 1:  # a wrapper called after what lies beside the article; comments lie two deep or are called so themselves
                self.void.update(around.names)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _SCOPE:
            self.scopes.append(len(self.open))
        self.open.append(_Element(tag, gone or headings and around.headings and tag not in HEADINGS and tag not in INLINE and tag not in CONTAINERS, region, names, headings))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        places = self.places.get(tag)
        if places and (tag in _SCOPE or not self.scopes or places[-1] >= self.scopes[-1]):
            self._pop(places[-1])

    def handle_data(self, data: str) -> None:
        e = self.open[-1]
        if not e.gone and (not e.headings or e.tag in HEADINGS or any(self.places.get(h) and self.places[h][-1] >= self.places["header"][-1] for h in HEADINGS)):
            self.parts.append(data)


def parse(html: str | None) -> tuple[list[str], list[int], list[int]]:
    """The blocks of a page that marks leave, the region of each, and the region around each region; null html has none."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    found = [(t, r) for t, r, names in page.blocks if page.void.issuperset(names)]
    return [t for t, _ in found], [r for _, r in found], page.parents


def story(texts: list[str], regions: list[int], parents: list[int], amounts: list[float]) -> tuple[list[int], bool]:
    """Places of the blocks of the article, by the amounts of text of the blocks, and whether a region was entered (or there is none)."""
    own = [0.0] * len(parents)
    for n, r in zip(amounts, regions, strict=True):
        own[r] += n
    whole = own[:]
    for r in range(len(parents) - 1, 0, -1):  # regions within come after
        whole[parents[r]] += whole[r]
    at, teasers = 0, False
    while True:
        within = [r for r in range(at + 1, len(parents)) if parents[r] == at]
        best = max(within, key=lambda r: whole[r], default=0)
        if not best or 3 * whole[best] <= 2 * whole[at]:
            teasers = 2 * own[at] > whole[at]
            break
        at = best
    inside = [False] * len(parents)
    inside[at] = True
    for r in range(at + 1, len(parents)):
        inside[r] = inside[parents[r]] and not teasers
    return [i for i, r in enumerate(regions) if inside[r]], at > 0 or not texts


def blocks(html: str | None) -> tuple[list[str], bool]:
    """The blocks of the article of a page that shares no text with others, and whether a region was entered (or there is none)."""
    texts, regions, parents = parse(html)
    kept, known = story(texts, regions, parents, [len(t) for t in texts])
    return [texts[i] for i in kept], known


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def stream(texts: list[str]) -> list[str]:
    """The tokens of blocks, a line end after each block."""
    return [w for t in texts for w in (*t.split(" "), "\n")]


def _times(n: int, repeated: list[tuple[int, int]]) -> np.ndarray:
    """How many of the repeated stretches (place, length) each of n tokens is in."""
    change = np.zeros(n + 1, np.int64)
    for at, k in repeated:
        change[at] += 1
        change[min(at + k, n)] -= 1
    return np.cumsum(change)[:n]


def unique_runs(texts: list[str], repeated: list[tuple[int, int]]) -> list[str]:
    """Blocks without the tokens of the repeated stretches (place, length)."""
    tokens = stream(texts)
    out, part = [], []
    for token, times in zip(tokens, _times(len(tokens), repeated), strict=True):
        if token == "\n":
            out += [" ".join(part)] if part else []
            part = []
        elif not times:
            part.append(token)
    return out


def main_blocks(texts: list[str], regions: list[int], parents: list[int], repeated: list[tuple[int, int]]) -> list[str]:
    """A page's article: the blocks of the region that was entered, or else what the repeated stretches leave."""
    if not repeated:
        return [texts[i] for i in story(texts, regions, parents, [len(t) for t in texts])[0]]
    spaces = [t.count(" ") for t in texts]
    starts = [0, *itertools.accumulate(n + 2 for n in spaces)]
    times, amounts = _times(starts[-1], repeated), [float(len(t) - n) for t, n in zip(texts, spaces, strict=True)]
    for i in {i for at, n in repeated for i in range(max(0, bisect.bisect_right(starts, at) - 1), min(len(texts), bisect.bisect_left(starts, at + n)))}:
        amounts[i] = sum(len(w) / (REPEATED if k else 1) for w, k in zip(texts[i].split(" "), times[starts[i] : starts[i + 1] - 1].tolist(), strict=True))
    kept, known = story(texts, regions, parents, amounts)
    if known:
        return [texts[i] for i in kept]
    inside = set(kept)
    gone = [(starts[i], starts[i + 1] - starts[i]) for i in range(len(texts)) if i not in inside]
    return unique_runs(texts, [*repeated, *gone])


_signed = lambda h: h - 2**64 if h >= 2**63 else h


class _Numbers:
    """part: a number of the rows that a task writes; row: of each of them; piece: of those that are hashed together; tokens."""

    def __init__(self) -> None:
        self.part, self.row, self.piece, self.chars, self.pages = uuid.uuid4().int >> 65, 0, 0, 0, 0

    def of(self, texts: list[str]) -> list[pa.Array]:
        pieces = []
        for t in texts:
            if self.chars >= CHARS or self.pages >= PAGES:
                self.piece, self.chars, self.pages = self.piece + 1, 0, 0
            self.chars, self.pages = self.chars + len(t), self.pages + 1
            pieces.append(self.piece)
        rows = range(self.row, self.row + len(texts))
        self.row += len(texts)
        return [pa.array([self.part] * len(texts), pa.int64()), pa.array(pieces, pa.int32()), pa.array(rows, pa.int32()), pa.array([t.count(" ") + 2 * t.count("\n") + 2 for t in texts], pa.int64())]


_NUMBERS = ("part", "piece", "row", "tokens")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page: tells apart what counts as different pages, those of other contents."""
    numbers = _Numbers()
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            got = [parse(h) for h in part.column(2).to_pylist()]
            texts = ["\n".join(t) for t, _, _ in got]
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([r for _, r, _ in got], pa.list_(pa.int32())), pa.array([p for _, _, p in got], pa.list_(pa.int32())), pa.array([host(u) for u in part.column(1).to_pylist()], pa.string()), pa.array([_signed(xxhash.xxh64_intdigest(t)) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *numbers.of(texts)], ["page_id", "url", "text", "regions", "parents", "host", "page", *_NUMBERS])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _Numbers()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, *numbers.of(batch.column(2).to_pylist())], ["host", "page", "text", *_NUMBERS])


@contextlib.contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes what actions within have shuffled as each ends: their rows are written, nothing reads it again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _beside(df: DataFrame, name: str) -> str:
    """Writes rows that belong to parts, for tasks that read the parts' texts: these are then nowhere shuffled."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _short_shuffles(df.sparkSession):
        df.repartition("part").write.partitionBy("part").parquet(path, compression="zstd")
    return path


def _read(path: str, part: int) -> list[dict]:
    files, root = filesystem(f"{path}/part={part}")
    names = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    out: list[dict] = []
    for name in names:
        with files.open_input_file(name) as f:
            out += pq.ParquetFile(f).read().to_pylist()
    return out


def _pieces(batches: Iterator[pa.RecordBatch], firsts: str) -> Iterator[tuple[int, int, list[int], list[str], pa.Array]]:
    """(part, piece, row, host, text), pieces in order -> (part, piece, rows, hosts, texts) of the pages that are first of their contents."""
    now, known, held = None, set(), []

    def whole() -> tuple[int, int, list[int], list[str], pa.Array]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return (*now, t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4))

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            if keys[at] != now:
                if held:
                    yield whole()
                if now is None or now[0] != keys[at][0]:
                    known = {r["row"] for r in _read(firsts, keys[at][0])}
                now, held = keys[at], []
            part = batch.slice(at, i - at)
            part = part.filter(pa.array([r in known for r in part.column(2).to_pylist()], pa.bool_()))
            held += [part] if part.num_rows else []
            at = i
    if held:
        yield whole()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tokens(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The streams of pages as bytes, a space after each token; where the tokens end in them, how many there are up to the end of
    each page, and a hash of each."""
    space = pa.scalar(" \n ", pa.large_string())
    texts = pc.binary_join_element_wise(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n "), space, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = bytes(texts.buffers()[2][offsets[0] : offsets[-1]]) + bytes(8)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8, len(data) - 8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))  # the eight bytes from each place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    each = _mixed((eight[starts] & mask[np.minimum(size, 8)]) ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(8, 64, 8):
        if not len(more := np.flatnonzero(size > k)):
            break
        each[more] = _mixed(each[more] * np.uint64(0x9E3779B97F4A7C15) + (eight[starts[more] + k] & mask[np.minimum(size[more] - k, 8)]))
    for i in np.flatnonzero(size > 64).tolist():
        each[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return data, ends, np.searchsorted(ends, offsets[1:] - offsets[0]), each


def _windows(hosts: list[str], texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What _tokens gives but hashes; of each window of RUN tokens in the streams its page's place, its own place among all tokens
    and a hash of it and the host."""
    data, ends, upto, each = _tokens(texts)
    lengths = np.diff(upto, prepend=0)
    h = np.zeros(max(0, len(each) - RUN + 1), np.uint64)
    for k in range(RUN):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += each[k : k + len(h)]
    of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[: len(h)]
    first = np.flatnonzero(np.arange(RUN, RUN + len(h)) <= np.repeat(upto, lengths)[: len(h)])  # windows that a page's end cuts are none
    of = of[first]
    return data, ends, upto, of, first, _mixed(h[first] + np.array([xxhash.xxh64_intdigest(x) for x in hosts], np.uint64)[of])


def _coded(x: np.ndarray, bits: int) -> bytes:
    """Sorted distinct numbers below 2**bits, 32 bits at most, in about two bits each and those that tell them from their neighbours (Elias-Fano)."""
    n = len(x)
    low = max(0, bits - n.bit_length())
    high = np.zeros(n + (1 << (bits - low)), bool)
    high[(x >> np.uint32(low)).astype(np.int64) + np.arange(n)] = True
    rest = np.unpackbits(x.astype(">u4").view(np.uint8).reshape(n, 4), axis=1)[:, 32 - low :]
    return struct.pack("<IB", n, bits) + np.packbits(high).tobytes() + np.packbits(rest).tobytes()


def _decoded(b: bytes) -> np.ndarray:
    n, bits = struct.unpack_from("<IB", b)
    low = max(0, bits - n.bit_length())
    size = n + (1 << (bits - low))
    end = 5 + (size + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, end - 5, 5), count=size)) - np.arange(n)
    rest = np.zeros((n, 32), np.uint8)
    rest[:, 32 - low :] = np.unpackbits(np.frombuffer(b, np.uint8, offset=end), count=n * low).reshape(n, low)
    return (high << low).astype(np.uint32) | np.packbits(rest, axis=1).view(">u4").ravel().astype(np.uint32)


def _heads(firsts: str, bits: int, dealt: int):
    """Pages -> (bucket, part, piece, seen, more): of each piece the hashes of its windows, in bits, the first of them (dealt) as bucket;
    and which of them several of its pages have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, piece, _, hosts, texts in _pieces(batches, firsts):
            *_, of, _, h = _windows(hosts, texts)
            if not len(h):
                continue
            h = np.sort(h >> np.uint64(64 - bits) << np.uint64(16) | of.astype(np.uint64))  # a piece has PAGES pages at most
            of, h = h & np.uint64(0xFFFF), h >> np.uint64(16)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            starts = np.flatnonzero(new)
            more = np.logical_or.reduceat(~new & np.concatenate([[False], of[1:] != of[:-1]]), starts)
            h = h[starts]
            bounds = np.searchsorted(h, np.arange((1 << dealt) + 1, dtype=np.uint64) << np.uint64(bits - dealt)).tolist()
            out = [(k, part, piece, _coded((h[i:j] & np.uint64((1 << (bits - dealt)) - 1)).astype(np.uint32), bits - dealt), np.packbits(more[i:j]).tobytes()) for k, (i, j) in enumerate(itertools.pairwise(bounds)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "piece", "seen", "more"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, part, piece, seen, more), by bucket -> (part, piece, bucket, n, hashes): to each piece, which of its windows several pages have."""

    def told(bucket: int, seen: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        found = [_decoded(b) for _, _, b, _ in seen]
        x = np.sort(np.concatenate(found))
        twice = [x[1:][x[1:] == x[:-1]], *(f[np.unpackbits(np.frombuffer(s[3], np.uint8), count=len(f)).astype(bool)] for f, s in zip(found, seen, strict=True))]
        twice, out = np.unique(np.concatenate(twice)), []
        for f, (part, piece, b, _) in zip(found, seen, strict=True):
            hit = np.intersect1d(f, twice, assume_unique=True)
            if len(hit):
                out.append((part, piece, bucket, len(hit), _coded(hit, b[4])))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "piece", "bucket", "n", "hashes"])

    last, seen = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and seen:
                yield told(last, seen)
                seen = []
            last = bucket
            seen.append(row)
    if seen:
        yield told(last, seen)


def _planes(x: np.ndarray) -> bytes:
    """The like bytes of numbers beside each other, which compresses well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _plain(b: memoryview, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * np.dtype(kind).itemsize).reshape(-1, n).T).view(kind).ravel()


def _packed(suffixes: list[tuple[int, str, int, int]]) -> bytes:
    """(head, tail, row, at), sorted and one at least, in a block."""
    head, tail, row, at = zip(*suffixes, strict=True)
    columns = (np.diff(np.array(head, np.uint64), prepend=np.uint64(0)), np.array(row, np.int32), np.array(at, np.int32), np.array([len(t) for t in tail], np.int32))
    return zstandard.compress(struct.pack("<I", len(head)) + b"".join(map(_planes, columns)) + "".join(tail).encode())


def _unpacked(block: bytes) -> Iterator[tuple[int, str, int, int]]:
    b = memoryview(zstandard.decompress(block))
    (n,) = struct.unpack_from("<I", b)
    head, row, at, size = (_plain(b[4 + i * n :], n, k) for i, k in ((0, np.uint64), (8, np.int32), (12, np.int32), (16, np.int32)))
    ends, text = np.cumsum(size), str(b[4 + 20 * n :], "utf-8")
    tails = [text[i:j] for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True)]
    return zip(np.cumsum(head, dtype=np.uint64).tolist(), tails, row.tolist(), at.tolist(), strict=True)


def _stretches(found: list[tuple[int, int, int]]) -> bytes:
    """(row, at, n) in a block."""
    x = np.array(sorted(found), np.int32).reshape(-1, 3).T
    return zstandard.compress(_planes(np.diff(x[0], prepend=np.int32(0))) + _planes(np.ascontiguousarray(x[1])) + x[2].astype(np.uint8).tobytes())


def _places(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = memoryview(zstandard.decompress(block))
    n = len(b) // 9
    return np.cumsum(_plain(b, n, np.int32)), _plain(b[4 * n :], n, np.int32), np.frombuffer(b, np.uint8, offset=8 * n)


_SEVERAL = -1  # in place of a row: a suffix that several pages have


def _met_here(suffixes: list[tuple[int, str, int, int]]) -> tuple[list[tuple[int, str, int, int]], list[tuple[int, int, int]]]:
    """Suffixes of one part, sorted -> those to deal out, and (row, at, n) of those that another page of the part has to their full
    depth. These know all that they can share, and one of SEVERAL pages meets the others in their place."""
    out, met, i = [], [], 0
    while i < len(suffixes):
        head, tail, row, _ = suffixes[i]
        j = i + 1
        while j < len(suffixes) and suffixes[j][0] == head and suffixes[j][1] == tail:
            j += 1
        if suffixes[j - 1][2] != row:
            n = _shared(tail, tail)
            met += [(r, a, n) for _, _, r, a in suffixes[i:j]]
            out.append((head, tail, _SEVERAL, 0))
        else:
            out += suffixes[i:j]
        i = j
    return out, met


_DEALT = [("bucket", pa.int32()), ("part", pa.int64()), ("met", pa.bool_()), ("block", pa.binary())]


def _suffixes(firsts: str, repeated: str, bits: int, dealt: int, buckets: int):
    """Pages -> (bucket, part, met, block): a suffix for each place whose window several pages have, dealt out by the first bits (buckets) of
    its head, a hash of the host and RUN tokens; met: stretches that are known here. Shorter suffixes than RUN can't repeat but as a whole page's."""

    def dealt_out(part: int, suffixes: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
        suffixes.sort()
        rest, met = _met_here(suffixes)
        out = [(k, part, False, _packed(list(g))) for k, g in itertools.groupby(rest, lambda s: s[0] >> (64 - buckets))]
        if met:
            out.append((part & ((1 << buckets) - 1), part, True, _stretches(met)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _DEALT, strict=True)], [n for n, _ in _DEALT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told, held = None, {}, []
        for part, piece, rows, hosts, texts in _pieces(batches, firsts):
            if part != last:
                if held:
                    yield dealt_out(last, held)
                last, told, held = part, {}, []
                for r in _read(repeated, part):
                    told.setdefault(r["piece"], []).append((r["bucket"], r["hashes"]))
            if piece not in told:
                continue
            several = np.sort(np.concatenate([_decoded(b) | np.uint64(k << (bits - dealt)) for k, b in told.pop(piece)]))
            data, ends, upto, of, first, h = _windows(hosts, texts)
            short = h >> np.uint64(64 - bits)
            hit = np.flatnonzero(several[np.minimum(np.searchsorted(several, short), len(several) - 1)] == short)
            of, first = of[hit], first[hit]
            at = first - np.concatenate([[0], upto[:-1]])[of]
            begin, end = ends[first + RUN - 1] + 1, ends[np.minimum(first + DEPTH, upto[of]) - 1]
            for page, place, i, j, head in zip(of.tolist(), at.tolist(), begin.tolist(), end.tolist(), h[hit].tolist(), strict=True):
                held.append((head, data[i:j].decode(), rows[page], place))
                if len(held) >= SUFFIXES:
                    yield dealt_out(part, held)
                    held = []
        if held:
            yield dealt_out(last, held)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, part, met, block), by bucket -> (part, block): stretches that suffixes share with one of another page."""

    def scanned(blocks: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        found: dict[int, list[tuple[int, int, int]]] = {}
        for page, at, n in _shared_by(sorted((head, tail, (part if row != _SEVERAL else _SEVERAL, row), at) for part, b in blocks for head, tail, row, at in _unpacked(b))):
            if page[1] != _SEVERAL:
                found.setdefault(page[0], []).append((page[1], at, n))
        return ((part, _stretches(f)) for part, f in found.items())

    last, blocks = None, []
    for batch in itertools.chain(batches, (None,)):
        out: list[tuple[int, bytes]] = []
        for bucket, part, met, block in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch else ((None, 0, False, b""),):
            if bucket != last and blocks:
                out += scanned(blocks)
                blocks = []
            last = bucket
            if met:
                out.append((part, block))
            elif block:
                blocks.append((part, block))
        columns = list(zip(*out, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["part", "block"])


def _shared_by(suffixes: list[tuple[int, str, tuple[int, int], int]]) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Suffixes (head, tail, page, at), sorted -> (page, at, n): those that share n >= RUN tokens with one of another page.

    A suffix shares most with a neighbour in the order; of suffixes of one page in a row, all but the last wait until
    one of another page comes. Those of SEVERAL pages are other pages to all and have no need to know.
    """
    last, waiting, met = None, [], None  # the suffix before; suffixes of its page in a row; the tail before these
    for row in suffixes:
        head, tail, page, at = row
        if last is None or head != last[0]:
            waiting, met = [row], None
        elif page == last[2]:
            waiting.append(row)
            if met is not None:
                yield page, at, _shared(met, tail)
        else:
            for _, t, p, a in waiting:
                yield p, a, _shared(t, tail)
            yield page, at, _shared(last[1], tail)
            waiting, met = [row], last[1]
        last = row


def _shared(a: str, b: str) -> int:
    """Tokens that suffixes of equal heads share, from their tails."""
    n = RUN
    for x, y in zip(a.split(" "), b.split(" "), strict=False):
        if x != y or not x:
            break
        n += 1
    return n


def _joined(firsts: str):
    """(part, block), by part -> (host, page, at, n): stretches, those that overlap or meet as one."""

    def whole(part: int, blocks: list[bytes]) -> pa.RecordBatch:
        row, at, n = (np.concatenate(c).astype(np.int64) for c in zip(*map(_places, blocks), strict=True))
        start = row << 32 | at
        order = np.argsort(start)
        start, end = start[order], np.maximum.accumulate((start + n)[order])
        new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        start, end = start[new], end[np.append(new[1:], len(end)) - 1]
        pages = {r["row"]: (r["host"], r["page"]) for r in _read(firsts, part)}
        hosts, ids = zip(*(pages[r] for r in (start >> 32).tolist()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(start & 0xFFFFFFFF), pa.array(end - start)], ["host", "page", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blocks = None, []
        for batch in batches:
            for part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and blocks:
                    yield whole(last, blocks)
                    blocks = []
                last = part
                blocks.append(block)
        if blocks:
            yield whole(last, blocks)

    return run


def _choose(repeated: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for batch in batches:
            texts = []
            for t, r, p, part, row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if part != last:
                    last, known = part, {x["row"]: x["found"] for x in _read(repeated, part)}
                texts.append("\n".join(main_blocks(t.split("\n") if t else [], r, p, [(x["at"], x["n"]) for x in known.get(row, ())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def _width(n: int, less: int, least: int = 0) -> int:
    """Bits that number n things, less so many."""
    return max(least, n.bit_length() - less)


def repeats(pages: DataFrame) -> DataFrame:
    """pages(host, page, text) -> (host, page, at, n): stretches of n tokens at a place of the page's stream that another page of
    the host has too. Rows of equal host and page count once. Pages that are written with their numbers are read as they are."""
    spark = pages.sparkSession
    if "part" not in pages.columns:
        pages = written(pages.select("host", "page", "text").mapInArrow(_numbered, "host string, page long, text string, part long, piece int, row int, tokens long"), "pages", "zstd")
    firsts = _beside(pages.groupBy("host", "page").agg(F.min(F.struct("part", "row")).alias("x")).select("host", "page", "x.part", "x.row"), "firsts")
    windows = pages.agg(F.sum("tokens")).first()[0] or 0
    bits, dealt = min(48, _width(windows, -SPARE)), min(20, _width(windows, 20))
    texts = pages.select("part", "piece", "row", "host", "text")
    heads = texts.mapInArrow(_heads(firsts, bits, dealt), "bucket int, part long, piece int, seen binary, more binary")
    told = heads.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "part long, piece int, bucket int, n long, hashes binary")
    path = _beside(told, "repeated")
    n = spark.read.schema("n long").parquet(path).agg(F.sum("n")).first()[0] or 0
    suffixes = texts.mapInArrow(_suffixes(firsts, path, bits, dealt, buckets := _width(n, 18, 4)), "bucket int, part long, met boolean, block binary")
    found = suffixes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_neighbours, "part long, block binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(_joined(firsts), "host string, page long, at long, n long")


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text), a row per row; other columns are ignored.

    White space within a block is one space, blocks are joined by \\n in page order, character references are
    decoded. Null or empty html, or a page of nothing but boilerplate: empty text. A null or odd url belongs to
    the host ''. Pages of equal contents count as one page, so copies don't erase each other. An article's headings are
    kept, also those in its own header; the rest of that header goes. Every page goes through the suffix array.
    """
    schema = "page_id long, url string, text string, regions array<int>, parents array<int>, host string, page long, part long, piece int, row int, tokens long"
    parsed = written(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_parse, schema), "parsed", "zstd")
    with_text = parsed.where("tokens > 2 or text <> ''")
    of_page = repeats(with_text).groupBy("host", "page").agg(F.collect_list(F.struct("at", "n")).alias("found"))  # no more than a page's tokens
    found = _beside(with_text.select("host", "page", "part", "row").join(of_page, ["host", "page"]).select("part", "row", "found"), "found")
    return parsed.select("page_id", "url", "text", "regions", "parents", "part", "row").mapInArrow(_choose(found), "page_id long, url string, text string")
