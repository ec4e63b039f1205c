"""Operator 7: WARC archives whose records are Zstandard frames of their own, sharing a dictionary.

A task writes its pages to archives of bounded size: it trains a dictionary on the archive's first records (at
most SAMPLE_BYTES of them), puts it into a leading skippable frame (magic 0x184D2A5D, as in the .warc.zst
convention) and compresses each record by itself, so that a reader needs nothing but the file and can start at
any record. Archives get names of their own in the shared folder; the manifest, a table that Spark commits,
names those of the attempts that succeeded, so files of lost attempts are never read.

Equal payloads of at least MIN_REVISIT bytes are found by digest with a partial aggregation; the page with the
largest id is written in full and the others as revisit records.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, written

MIN_REVISIT = 1000
DICT_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES, LEVEL = 1 << 16, 1 << 22, 1 << 28, 3
_SKIPPABLE, _FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("payload", pa.binary())])


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    value = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _header(value: str) -> str:
    """Control characters would end a header line; they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, leader: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    head += [f"WARC-Target-URI: {_header(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: {_record_id(leader)}", f"WARC-Profile: {_PROFILE}"] if revisits else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """Trained on the records; of few or small ones, which can't be trained on, their own bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[:DICT_BYTES]


class _Archive:
    """An archive being written: holds records until there are enough to train the dictionary."""

    def __init__(self, root: str) -> None:
        self.files, base = filesystem(root)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.uri = f"{base}/{self.name}", f"{root}/{self.name}"
        self.files.create_dir(base, recursive=True)
        self.held: list[bytes] = []
        self.size = self.count = 0
        self.out = self.compressor = None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.count += 1
        if self.out is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.compressor.compress(data))

    def _open(self) -> None:
        raw = _dictionary(self.held)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
        self.out = self.files.open_output_stream(self.path, compression=None)  # else it compresses by file name
        self.out.write(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
        info = b"software: quarryline\r\nformat: WARC File Format 1.1\r\n"
        self.out.write(self.compressor.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> dict:
        if self.out is None:
            self._open()
        self.out.close()
        return {"archive": self.uri, "records": self.count, "bytes": self.size}


def write_archives(pages: DataFrame, root: str | None = None) -> DataFrame:
    """pages(page_id, url, html) -> manifest(archive, records, bytes), committed.

    Null html is an empty payload, null url writes no target; other columns are ignored. Rows with the same
    id and payload are all responses if that id is the largest; a null id counts as the smallest and, if a
    group has no other, all its rows are responses. No pages, no archives.
    """
    root = root or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    leaders = rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("copies"))
    # Written, so that both sides of the join are plain exchanges, whose hot keys Spark can split.
    leaders = written(leaders.where("copies > 1 and leader is not null").select("digest", "leader"), "leaders")
    rows = rows.join(leaders, "digest", "left").select("page_id", "url", "html", "digest", F.expr("leader is not null and not (page_id <=> leader)").alias("revisits"), "leader")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, html, digest, revisits, leader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(root)
                archive.add(record(page_id, url, html.encode(), digest, revisits, leader))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        done += [archive.close()] if archive else []
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(rows.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def _records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    head = stream.read(8)
    raw = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _SKIPPABLE:
        raw = stream.read(struct.unpack("<I", head[4:])[0])
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == _FRAME else raw
    else:
        stream.seek(0)
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None).stream_reader(stream, read_across_frames=True), 1 << 20)
    while first := reader.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("no WARC record where one should start")
        fields = {}
        while (line := reader.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[key] = value
        block = reader.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or reader.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            files, path = filesystem(uri)
            rows, size = [], 0
            with files.open_input_file(path) as stream:
                for fields, block in _records(stream):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest, full = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                    if full and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{uri}: payload differs from its digest")
                    rows.append({"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if full else _page_id(fields["WARC-Refers-To"]), "archive": uri, "payload": payload if full else None})
                    size += len(block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORD)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives named, whose responses are checked against their digests; revisits have no payload."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(n).mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, payload binary")
