"""Operator 10: chat formatting by columnar byte assembly.

A turn is written as <|turn|> ROLE <|text|> TEXT <|end|>. Control strings inside roles and texts (those of the
template and common ones of other templates) get a backslash after their first character; a control string
that already has backslashes there gets one more, so taking one away from each restores the text exactly.

Turns are hashed to partitions by conversation and sorted; a task then handles whole runs of conversations at
once: it computes the lengths of all segments, their offsets by a cumulative sum and the target index of each
byte, and copies headers and contents into one buffer that becomes the Arrow string column. A task holds one
batch and one conversation, which is one output value and hence at most 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>"
#: Control strings without their first character.
_TAILS = r"(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*){_TAILS}", rf"([<\[])\\(\\*){_TAILS}"
#: Bytes copied by one scatter index; bytes of text to an output batch, if it has more than one conversation.
_BLOCK, _BATCH_BYTES = 1 << 20, 1 << 28
FORMATTED = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_lengths array<long>"


def _escaped(col: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(col, pattern=ESCAPE, replacement=r"\1\\\2\3")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column."""
    col = col.cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    return off, np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)


def _copy(out: np.ndarray, at: np.ndarray, off: np.ndarray, data: np.ndarray) -> None:
    """Bytes off[i]:off[i + 1] of data go to out[at[i]:], by a scatter index, a block of rows at a time."""
    i, n = 0, len(at)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _BLOCK, "right")) - 1)
        if j == i + 1:
            out[at[i] : at[i] + off[j] - off[i]] = data[off[i] : off[j]]
        else:
            lengths = np.diff(off[i : j + 1])
            out[np.repeat(at[i:j] - off[i:j], lengths) + np.arange(off[i], off[j])] = data[off[i] : off[j]]
        i = j


def assemble(ids: list, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row per run of equal ids; the turns are in order."""
    n = len(ids)
    loss = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False).astype(bool)
    (r_off, r_data), (t_off, t_data) = _flat(_escaped(roles)), _flat(_escaped(texts))
    r_len, t_len = np.diff(r_off), np.diff(t_off)
    size = len(TURN) + r_len + len(TEXT) + t_len + len(END)
    start = np.concatenate(([0], np.cumsum(size)))
    at, out = start[:-1], np.empty(start[-1], np.uint8)
    r_at = at + len(TURN)
    t_at = r_at + r_len + len(TEXT)
    for header, where in ((TURN, at), (TEXT, r_at + r_len), (END, t_at + t_len)):
        out[where[:, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    _copy(out, r_at, r_off, r_data)
    _copy(out, t_at, t_off, t_data)
    first = np.array([0, *(i for i in range(1, n) if ids[i] != ids[i - 1])])
    edges = np.append(first, n)
    if np.diff(start[edges]).max() >= 2**31:
        raise ValueError("a formatted conversation exceeds 2 GB")
    group = np.searchsorted(edges, np.arange(n), "right") - 1
    picked = np.flatnonzero(loss)
    lists = np.concatenate(([0], np.cumsum(np.bincount(group[picked], minlength=len(first))))).astype(np.int32)
    of = lambda x: pa.ListArray.from_arrays(pa.array(lists), pa.array(x.astype(np.int64)))
    text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(start[edges].astype(np.int64)), pa.py_buffer(out)])
    columns = [pa.array([ids[i] for i in first], pa.int64()), pa.array(np.diff(edges), pa.int64()), text.cast(pa.string()), of((t_at - start[edges[group]])[picked]), of(t_len[picked])]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "loss_starts", "loss_lengths"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []  # rows of the conversation that goes on

    def done() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        ids = t["conv_id"].to_pylist()
        sizes = np.cumsum(pc.add(pc.binary_length(t["text"]), pc.binary_length(t["role"])).to_numpy().astype(np.int64))
        begin, spent = 0, 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[i - 1] and sizes[i - 1] - spent >= _BATCH_BYTES:
                part = t.slice(begin, i - begin)
                yield assemble(ids[begin:i], pa.chunked_array(part["role"].chunks, pa.string()), pa.chunked_array(part["text"].chunks, pa.string()))
                begin, spent = i, sizes[i - 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        table, ids = pa.Table.from_batches([batch]), batch.column(0).to_pylist()
        cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0)
        if held and (cut or held[-1]["conv_id"][-1].as_py() != ids[0]):
            if held[-1]["conv_id"][-1].as_py() != ids[0]:
                yield from done()
                held = []
        if cut:
            held.append(table.slice(0, cut))
            yield from done()
            held = []
        held.append(table.slice(cut))
    if held:
        yield from done()


def format_chat(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> FORMATTED: one row per conversation, with the spans of assistant
    texts (in bytes of the UTF-8 form) that a loss is taken over.

    Turns are ordered by turn, then role, then text (nulls first); rows repeated are turns repeated. Null
    text or role: empty. Null conv_ids form one conversation. No rows, no conversations. Other columns are
    ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    back = lambda s: re.sub(UNESCAPE, r"\1\2\3", s)
    out = []
    for part in formatted.split(TURN.decode())[1:]:
        role, mark, text = part.partition(TEXT.decode())
        if not mark or not text.endswith(END.decode()):
            raise ValueError("not a formatted conversation")
        out.append((back(role), back(text[: -len(END)])))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            conv, text, starts, lengths = (batch.column(k)[i].as_py() for k in range(4))
            turns, raw = parse(text), text.encode()
            loss = [re.sub(UNESCAPE, r"\1\2\3", raw[a : a + n].decode()) for a, n in zip(starts, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([[r for r, _ in turns]], pa.list_(pa.string())), pa.array([[t for _, t in turns]], pa.list_(pa.string())), pa.array([loss], pa.list_(pa.string())), pa.array([len(text)], pa.int64())], ["conv_id", "roles", "texts", "loss_texts", "formatted_chars"])


def read_chat(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts read back from format_chat's output, one row per conversation."""
    rows = formatted.select("conv_id", "formatted", "loss_starts", "loss_lengths")
    return rows.mapInArrow(_read, "conv_id long, roles array<string>, texts array<string>, loss_texts array<string>, formatted_chars long")
