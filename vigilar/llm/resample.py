"""Importance resampling towards a target: hashed word and word-pair features, bucket gains, Gumbel top-k draw.

An untrained pre-tokenizer splits every text into words with byte offsets. A feature is a run of consecutive words joined by
one space; its bucket is a checksum of its bytes. A document weighs the mean gain of its features' buckets, where a gain
compares the share of a bucket in the target with its share in the source. Noise drawn from the document's id makes the
draw of the highest scores a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from .shared import new_folder, ranked, staged
from .textbytes import row_slices, text_bytes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # over text whose A-Z are lowered
LONGEST = 2  # words of the longest feature
BUCKETS = 10_000
SHORTEST = 20  # words of a document that can be drawn
PERCENT = 25  # of those documents are drawn
SEED = 7
AT_ONCE = 1 << 18  # bytes that the pre-tokenizer takes at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_LONG_WORD = 48  # bytes from which on a word's checksum is taken on its own


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_on(state: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``state`` stands for followed by the bytes start..end of ``raw``, for all rows at once."""
    out = state.copy()
    size = end - start
    long_ = np.flatnonzero(size > _LONG_WORD)
    for i in long_:
        out[i] = zlib.crc32(raw[start[i]:end[i]].tobytes(), int(state[i]))
    rows = np.flatnonzero(size <= _LONG_WORD)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    at, left = start[rows], size[rows]
    now = ~state[rows]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # words longer than j come first
        now[:n] = _CRC[(now[:n] ^ raw[at[:n] + j]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[rows] = ~now
    return out


def _cuts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about AT_ONCE bytes that end behind a byte of no word."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + AT_ONCE)
        while end < len(raw) and _WORD_BYTE[raw[end - 1]]:
            end += 1
        yield at, end
        at = end


def word_offsets(raw: np.ndarray, split) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words of one text whose A-Z are lowered."""
    found = []
    for lo, hi in _cuts(raw):
        text = PreTokenizedString(raw[lo:hi].tobytes().decode())
        split.pre_tokenize(text)
        pairs = [piece[1] for piece in text.get_splits("original", "byte")]
        if pairs:
            found.append(np.array(pairs, np.int64) + lo)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, split, longest: int = LONGEST, buckets: int = BUCKETS) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features of all rows in row order, number of features a row, number of words a row)."""
    low = _LOWER[raw]
    starts, ends, words = [], [], []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        s, e = word_offsets(low[lo:hi], split)
        starts.append(s + lo)
        ends.append(e + lo)
        words.append(len(s))
    start, end, words = np.concatenate(starts), np.concatenate(ends), np.array(words, np.int64)
    row = np.repeat(np.arange(len(words)), words)
    state = crc_on(np.zeros(len(start), np.uint32), low, start, end)
    crcs, rows = [state], [row]
    blank = np.full(1, 32, np.uint8)
    for n in range(2, longest + 1):
        m = len(start) - n + 1
        inside = np.flatnonzero(row[:m] == row[n - 1:]) if m > 0 else np.zeros(0, np.int64)
        head = state[inside]  # of the run one word shorter
        head = crc_on(head, blank, np.zeros(len(head), np.int64), np.ones(len(head), np.int64))
        tail = inside + n - 1
        grown = np.zeros(max(m, 0), np.uint32)
        grown[inside] = crc_on(head, low, start[tail], end[tail])
        state = grown
        crcs.append(grown[inside])
        rows.append(row[inside])
    crc, of = np.concatenate(crcs), np.concatenate(rows)
    order = np.argsort(of, kind="stable")
    return (crc[order] % np.uint32(buckets)).astype(np.uint16), np.bincount(of, minlength=len(words)), words


def _features(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets):
                found, n, words = feature_buckets(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], split, longest, buckets)
                ends = np.concatenate([[0], np.cumsum(2 * n)])
                blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words), pa.array(n), blob.cast(pa.binary())],
                                                 ["doc_id", "n_words", "n_features", "buckets"])
    return run


def hashed_features(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row; buckets holds one unsigned 16-bit number a feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbers of 16 bits")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_features(longest, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _numbers(blob: pa.Array) -> np.ndarray:
    raw, _ = text_bytes(blob)
    return np.frombuffer(raw.tobytes(), np.uint16)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. Every task adds up its own; at most ``buckets`` rows reach the driver."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("buckets").mapInArrow(add_up, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, rounded down."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * s_all / ((int(s) + 1) * t_all))) for s, t in zip(source, target)], np.int64)


def _scored(gains: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[_numbers(batch.column(3))])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            noise = []
            for i in ids.to_pylist():
                h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
                noise.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight), pa.array(weight + np.array(noise, np.int64))],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             longest: int = LONGEST, buckets: int = BUCKETS, shortest: int = SHORTEST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: key, n_features, weight, score and rank among the drawn (1, 2, 3 ...; null: not drawn).

    ``percent`` of the rows with at least ``shortest`` words are drawn, rounded down; ties go to the smaller key, a null key
    last. Null and empty texts have no feature, weight 0 and are never drawn. A null key draws its noise from an empty
    key. Rows that share a key share their noise; fully equal rows take consecutive ranks. An empty table gives an
    empty result, an empty target leaves every bucket to the smoothing. Texts are read and split once; their buckets, two
    bytes a feature, are written to the shared folder, so counting and scoring read numbers only.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "resample-features")
    features = hashed_features(docs, key, text, longest, buckets)
    features.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(features.schema).parquet(path)
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias(key), F.col(target_text).alias(text)), key, text, longest, buckets)
    gains = bucket_gains(bucket_counts(kept, buckets), bucket_counts(wanted, buckets))
    scored = staged(kept.mapInArrow(_scored(gains, seed), "doc_id long, n_words long, n_features long, weight long, score long"), "resample-scores")
    fits = F.col("n_words") >= shortest
    drawn = percent * scored.filter(fits).count() // 100
    queue = scored.select("*", (~fits).alias("__late"), (-F.col("score")).alias("__down"), F.rand(seed).alias("__salt"), F.lit(1).cast("long").alias("rank"))
    queue = ranked(queue, ["__late", "__down", "doc_id", "n_features", "__salt"], {"rank": F.col("rank")}, "resample-queue")
    rank = F.when(fits & (F.col("rank") <= drawn), F.col("rank"))
    return queue.select(F.col("doc_id").alias(key), "n_features", "weight", "score", rank.alias("rank"))
