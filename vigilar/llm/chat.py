"""Chat formatting by columnar byte assembly: lengths of all segments, running offsets and scatter indices in numpy, headers
and contents copied into one buffer.

A turn is ``### role: text</turn>`` and a line end. In texts and roles a backslash stands before every backslash and before
every control string, so unescaped control strings are the template's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .textbytes import text_bytes

OPEN, CLOSE = b"### ", b"</turn>\n"
SLASH = 92
CONTROLS = (b"###", b"</turn>", b"\\")
ROLE_CONTROLS = (*CONTROLS, b":")
TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>\n))*)</turn>\n", re.DOTALL)
LOSS_ROLE = "assistant"
FORMATTED = "conv long, formatted string, loss_from array<long>, loss_to array<long>"


def escaped(buf: np.ndarray, offsets: np.ndarray, controls: tuple[bytes, ...] = CONTROLS) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a backslash before every control string that lies within a row, and their new offsets."""
    n = len(buf)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    mark = np.zeros(n, bool)
    for c in controls:
        hit = np.flatnonzero(buf == c[0])
        for k in range(1, len(c)):
            hit = hit[hit + k < row_end[hit]]
            hit = hit[buf[hit + k] == c[k]]
        mark[hit] = True
    moved = np.concatenate([[0], np.cumsum(mark)])
    out = np.full(n + moved[-1], SLASH, np.uint8)
    out[np.arange(n) + moved[1:]] = buf
    return out, offsets + moved[offsets]


def unescaped(raw: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", raw, flags=re.DOTALL) if b"\\" in raw else raw


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Scatters segments of ``source`` to the places ``to``."""
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + step] = source[np.repeat(start, length) + step]


def assembled(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """FORMATTED rows of whole conversations whose turns stand in order."""
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    known = conv.is_valid().to_numpy(zero_copy_only=False)
    body, at = escaped(*text_bytes(text))
    coded = role.fill_null("").dictionary_encode()
    names = coded.dictionary.to_pylist()
    heads = []
    for name in names:
        raw = np.frombuffer(name.encode(), np.uint8)
        safe, _ = escaped(raw, np.array([0, len(raw)]), ROLE_CONTROLS)
        heads.append(OPEN + safe.tobytes() + b": ")
    which = coded.indices.to_numpy()
    head_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    head, tail = np.frombuffer(b"".join(heads), np.uint8), np.frombuffer(CLOSE, np.uint8)
    head_len, body_len = np.diff(head_at)[which], np.diff(at)
    length = head_len + body_len + len(CLOSE)
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(start[-1], np.uint8)
    _copy(out, start[:-1], head, head_at[which], head_len)
    _copy(out, start[:-1] + head_len, body, at[:-1], body_len)
    _copy(out, start[1:] - len(CLOSE), tail, np.zeros(len(which), np.int64), np.full(len(which), len(CLOSE)))
    change = np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1 if len(ids) else np.zeros(0, int)
    first = np.concatenate([[0], change]) if len(ids) else change
    bounds = np.concatenate([start[first], start[-1:]])
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    learn = np.array([n == LOSS_ROLE for n in names], bool)[which]
    conv_of = np.searchsorted(first, np.arange(len(which)), "right") - 1
    base = chars[bounds[:-1]][conv_of]
    begin, stop = start[:-1] + head_len, start[1:] - len(CLOSE)
    spans = np.concatenate([[0], np.cumsum(np.bincount(conv_of[learn], minlength=len(first)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array((chars[p] - base)[learn])) for p in (begin, stop)]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), formatted.cast(pa.string()), *lists],
                                      ["conv", "formatted", "loss_from", "loss_to"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by conversation; the last one of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        open_id = held[-1].column(0)[-1].as_py() if held else ids[0]
        held.append(batch)
        if ids[-1] == open_id and (len(held) > 1 or ids[0] == open_id):
            continue  # sorted: the whole batch goes on with the open conversation
        cut = len(ids) - 1
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        held[-1] = batch.slice(0, cut)
        yield _whole(held)
        held = [batch.slice(cut)]
    if held:
        yield _whole(held)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return assembled(*[table.column(i).combine_chunks() for i in range(3)])


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """FORMATTED: one row per conversation with code-point ranges of the assistant's texts (the loss mask).

    Rows of a conversation stand in the order of their turn, then role, then text, nulls first. Null texts and roles are empty;
    rows with a null conversation form one. A conversation is streamed in sorted batches and held once, as its own string.
    An empty table gives an empty result.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
                        F.col(turn).alias("turn"))
    placed = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    return placed.mapInArrow(_format, FORMATTED)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    raw, at, out = formatted.encode(), 0, []
    while at < len(raw):
        m = TURN.match(raw, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescaped(m[1]).decode(), unescaped(m[2]).decode()))
        at = m.end()
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, begin, stop in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            turns = turns_of(formatted)
            whole = hashlib.sha256()
            for r, t in turns:
                whole.update(f"{r}\n{t}\n".encode())
            loss = [unescaped(formatted[a:b].encode()).decode() for a, b in zip(begin, stop)]
            rows.append((conv, len(turns), whole.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(formatted)))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                         ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def round_trip(turns: DataFrame, **columns: str) -> DataFrame:
    """Digests of every conversation, parsed back from the formatted output."""
    written = staged(format_chats(turns, **columns), "chats")
    return written.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
