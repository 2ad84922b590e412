"""Removes words covered by a window of ``width`` words that also starts in a document with a smaller id.

Windows are counted by a count-min sketch first. Every chunk of documents makes the sketch of its own windows; the sketches
are merged cell by cell, dealt out over the cells, and every chunk gets back one bit for each of its cells: whether the merged
count is above one. Merged counts are never too low, so only windows whose cells all say so can be repeated. These alone,
with the least id a chunk has for them, are grouped exactly, and again one bit for each comes back.

So the sketch has a fixed number of cells per window, lies nowhere as a whole, and nothing is broadcast or collected. A window
found in most documents is one entry per chunk. Texts are staged once, bucketed by chunk; none of the passes shuffles them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, staged
from .slices import joined, slice_hashes, spread, word_bounds
from .textbytes import U, text_bytes

WIDTH = 13  # words of a window
DEPTH = 2  # sketch rows, one for each of a window's two prints; a window is looked at exactly if all its cells are shared
CHUNK_BYTES = 1 << 23  # text whose windows a task holds at once; a longer document is a chunk of its own
SHARD_CELLS = 1 << 20  # entries that a task merges, about
_STEP = np.random.default_rng(13).integers(1, 1 << 62, (2, 4096), dtype=np.uint64) * U(2) + U(1)
_ZSTD = "zstd"

CHUNKS = "chunk long, doc_id long, text string, n_bytes long"
MESSAGE = "shard long, chunk long, n long, cells binary"
REPLY = "chunk long, exact boolean, shard long, n long, bits binary"


def _into_chunks(chunk_bytes: int):
    """Numbers the chunks of a partition."""
    def run(batches):
        number, size = 0, 0
        for batch in batches:
            part, ids, texts = batch.columns
            _, offsets = text_bytes(texts)
            chunk = np.zeros(batch.num_rows, np.int64)
            for i, n in enumerate(np.diff(offsets).tolist()):
                if size and size + n > chunk_bytes:
                    number, size = number + 1, 0
                size += n
                chunk[i] = number
            key = (part.to_numpy().astype(np.int64) << 32) + chunk
            yield pa.RecordBatch.from_arrays([pa.array(key), ids, texts, pa.array(np.diff(offsets))], ["chunk", "doc_id", "text", "n_bytes"])
    return run


def staged_chunks(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_id, text, n_bytes) as a bucketed table in the shared folder, so that grouping by chunk moves no text."""
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = min(100_000, max(16, 4 * rows.rdd.getNumPartitions()))
    name = f"window_chunks_{uuid.uuid4().hex}"
    rows.mapInArrow(_into_chunks(chunk_bytes), CHUNKS).write.format("parquet").bucketBy(buckets, "chunk").option("path", new_folder(spark, "window-chunks")).saveAsTable(name)
    return spark.table(name)


class _Windows:
    """The words and windows of a chunk, in row order; rows without an id have no windows."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.ids = table.column("doc_id").combine_chunks()
        self.raw, self.offsets = text_bytes(table.column("text"))
        self.start, self.end, self.row = word_bounds(self.raw, self.offsets)
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        n = max(0, len(self.start) - width + 1)
        self.at = np.flatnonzero((self.row[:n] == self.row[width - 1:]) & known[self.row[:n]]) if n else np.zeros(0, np.int64)
        self.doc = self.ids.fill_null(0).to_numpy()[self.row[self.at]]
        words = slice_hashes(self.raw, self.start, self.end)
        self.print = []
        for step in _STEP:
            rolled = np.full(n, U(width), np.uint64)
            for k in range(width if n else 0):
                rolled += words[k:k + n] * step[k]
            self.print.append(spread(rolled[self.at]))

    def cells(self, depth: int, bits: int) -> np.ndarray:
        """The cell of every window in a sketch row of 2 ** bits cells."""
        return self.print[depth] >> U(64 - bits)

    def candidates(self, replies: pa.Table, bits: int, shard_bits: int):
        """(window places by print, first of each group, prints of the groups, least document of each group)."""
        places = np.arange(len(self.at))
        for d in range(DEPTH):
            cells = self.cells(d, bits)
            shared = _capped(np.sort(cells), 1)[_bits_of(replies, False, range(d << shard_bits, (d + 1) << shard_bits))]
            places = places[_among(cells[places], shared)]
        one, two = self.print[0][places], self.print[1][places]
        order = np.lexsort((two, one))
        places, one, two = places[order], one[order], two[order]
        if not len(places):
            return places, places, one, two, self.doc[places]
        first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        return places, first, one[first], two[first], np.minimum.reduceat(self.doc[places], first)


def _capped(ordered: np.ndarray, times: int) -> np.ndarray:
    """Sorted values, each at most so many times."""
    keep = np.ones(len(ordered), bool)
    keep[times:] = ordered[times:] != ordered[:-times]
    return ordered[keep]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ones; a table of flags spares most of the searches."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    def slot(v):
        return (v * U(0x9E3779B97F4A7C15)) >> U(64 - 22)
    flags = np.zeros(1 << 22, bool)
    flags[slot(ordered)] = True
    out = flags[slot(x)]
    some = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(ordered, x[some]), len(ordered) - 1)
    out[some] = ordered[place] == x[some]
    return out


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit words, byte planes one after another."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.compress(planes, codec=_ZSTD, asbytes=True)


def _unpacked(blob: bytes, n: int, width: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 8 * n * width, codec=_ZSTD, asbytes=True), np.uint8).reshape(width, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U(0))


def _dealt(chunk: int, keys: np.ndarray, key_bits: int, shard_bits: int, first_shard: int, *others: np.ndarray) -> pa.Table:
    """Messages of sorted keys, cut by their leading bits into shards."""
    shard = (keys >> U(key_bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keys))
    blobs = [_packed(_gaps(keys[a:b]), *[o[a:b] for o in others]) for a, b in zip(cut, ends)]
    return pa.table({"shard": pa.array(shard[cut] + first_shard), "chunk": pa.array(np.full(len(cut), chunk)), "n": pa.array(ends - cut),
                     "cells": pa.array(blobs, pa.binary())})


def _bits_of(replies: pa.Table, exact: bool, shards: range) -> np.ndarray:
    """The bits told to a chunk by some shards, in their order."""
    exacts, shard, n, bits = (replies.column(c).to_pylist() for c in ("exact", "shard", "n", "bits"))
    mine = sorted((s, k) for k, s in enumerate(shard) if exacts[k] == exact and s in shards)
    parts = [np.unpackbits(np.frombuffer(bits[k], np.uint8), count=n[k]) for _, k in mine]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)) > 0


def _reply(chunks: list, exact: bool, shard: int, told: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "exact": pa.array([exact] * len(chunks)), "shard": pa.array([shard] * len(chunks), pa.int64()),
        "n": pa.array([len(t) for t in told], pa.int64()), "bits": pa.array([np.packbits(t).tobytes() for t in told], pa.binary())})


def _merged_counts(key: tuple, table: pa.Table) -> pa.Table:
    """Adds up the sketches of all chunks over the cells of one shard; tells each chunk which of its cells count above one."""
    chunks, sizes, blobs = (table.column(c).to_pylist() for c in ("chunk", "n", "cells"))
    cells = [np.cumsum(_unpacked(b, n, 1)[0], dtype=np.uint64) for b, n in zip(blobs, sizes)]
    _, place, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    above, at, told = count[place] > 1, 0, []
    for c in cells:
        told.append(above[at:at + len(c)][np.append(True, c[1:] != c[:-1])])
        at += len(c)
    return _reply(chunks, False, key[0].as_py(), told)


def _least_documents(key: tuple, table: pa.Table) -> pa.Table:
    """Groups windows by their whole prints; tells each chunk for which of them another one has a smaller document."""
    chunks, sizes, blobs = (table.column(c).to_pylist() for c in ("chunk", "n", "cells"))
    parts = [_unpacked(b, n, 3) for b, n in zip(blobs, sizes)]
    one = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    two, doc = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).view(np.int64)
    order = np.lexsort((doc, two, one))
    new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
    least = np.empty(len(doc), np.int64)
    least[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return _reply(chunks, True, key[0].as_py(), np.split(least < doc, np.cumsum(sizes)[:-1]))


def remove_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, with_text: bool = True,
                            chunk_bytes: int = CHUNK_BYTES, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text (kept words joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. Null and empty texts have no words; texts of fewer words than
    ``width`` lose none. Rows that share a key take nothing from each other, but lose what a smaller key has. A row without
    a key neither takes nor loses anything. An empty table gives an empty result. Windows are told apart by two prints of 64
    bits, independent sums over their words' hashes.
    """
    if not 0 < width <= _STEP.shape[1]:
        raise ValueError(f"a window has 1 to {_STEP.shape[1]} words")
    chunks = staged_chunks(docs, key, text, chunk_bytes)
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(10, int(2 * size // 3).bit_length() + 1)  # 8 to 16 cells a window of some six bytes
    shard_bits = max(0, (size // 6 // shard_cells).bit_length())

    def sketch(chunk: tuple, table: pa.Table) -> pa.Table:
        windows = _Windows(table, width)
        rows = [_dealt(chunk[0].as_py(), _capped(np.sort(windows.cells(d, bits)), 2), bits, shard_bits, d << shard_bits) for d in range(DEPTH)]
        return pa.concat_tables(rows)

    def repeated(chunk: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _dealt(0, np.zeros(0, np.uint64), 64, 0, 0)
        _, _, one, two, doc = _Windows(table, width).candidates(replies, bits, shard_bits)
        return _dealt(chunk[0].as_py(), one, 64, shard_bits, 0, two, doc.view(np.uint64))

    def kept(chunk: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        windows = _Windows(table, width) if table.num_rows else None
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        if windows is not None:
            places, first, _, _, least = windows.candidates(replies, bits, shard_bits)
            told = _bits_of(replies, True, range(1 << shard_bits))
            sizes = np.diff(np.append(first, len(places)))
            gone = places[np.repeat(told, sizes) | (windows.doc[places] > np.repeat(least, sizes))] if len(places) else places
            cover = np.zeros(len(windows.start) + 1, np.int64)
            np.add.at(cover, windows.at[gone], 1)
            np.add.at(cover, windows.at[gone] + width, -1)
            stays = np.cumsum(cover)[:-1] == 0
            raw, bounds = joined(windows.raw, windows.start[stays], windows.end[stays])
            rows = np.arange(len(windows.offsets))
            n_words = np.diff(np.searchsorted(windows.row, rows))
            ends = np.searchsorted(windows.row[stays], rows)
            for a, b in zip(bounds[ends[:-1]], bounds[ends[1:]]):
                rest = raw[a:max(a, b - 1)].tobytes()
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["kept_text"].append(rest.decode() if with_text else None)
            out |= {"doc_id": windows.ids, "n_words": n_words, "n_removed": n_words - np.diff(ends)}
        return pa.table([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in _RESULT], schema=_RESULT)

    by_chunk = chunks.groupBy("chunk")
    messages = by_chunk.applyInArrow(sketch, MESSAGE)
    shared = staged(messages.groupBy("shard").applyInArrow(_merged_counts, REPLY), "window-counts")
    asked = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(repeated, MESSAGE)
    smaller = staged(asked.groupBy("shard").applyInArrow(_least_documents, REPLY), "window-least")
    out = by_chunk.cogroup(shared.union(smaller).groupBy("chunk")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.withColumnRenamed("doc_id", key)
    return out if with_text else out.drop("kept_text")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
