"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Candidates are star-shaped: every document of a bucket is paired with the bucket's least document only, so a bucket of
n documents gives n - 1 pairs. Links are confirmed on the full shingle sets. Buckets that still hold more than one
component afterwards go through an exact prefix join, so no link between different groups is lost to the stars. Sets of few
shingles, whose sketches repeat few values, go through it in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import component_labels
from .shared import staged
from .textbytes import U, mix, row_slices, signed, text_bytes, word_hashes

WORDS = 5
BANDS, ROWS = 40, 4  # a pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 4) ** 40, under 3e-7, where bins
# are filled independently. Small sets fill few bins, so they do not rely on bands:
FEW = 48  # sets with at most so many shingles all go through the exact join
ATTEMPTS = 1024

_RNG = np.random.default_rng(75)
_STEP = _RNG.integers(1, 1 << 62, WORDS, dtype=np.uint64) * U(2) + U(1)
_BAND = _RNG.integers(1, 1 << 62, ROWS, dtype=np.uint64) * U(2) + U(1)
_BAND_OF = _RNG.integers(1, 1 << 62, BANDS, dtype=np.uint64)
_PROBE = _RNG.integers(0, BANDS * ROWS, (ATTEMPTS, BANDS * ROWS))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after another, bounds of the rows)."""
    words, _, _, bounds = word_hashes(buf, offsets, True)
    n = len(words)
    rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += words[k:k + len(rolled)] * _STEP[k]
    rolled = mix(rolled)
    sets = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= WORDS:
            sets.append(np.unique(rolled[lo:hi - WORDS + 1]))
        elif hi > lo:
            sets.append(mix((words[lo:hi] * _STEP[:hi - lo]).sum(dtype=np.uint64, keepdims=True) + U(hi - lo)))
        else:
            sets.append(words[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else words[:0]), np.concatenate([[0], np.cumsum(sizes)])


def densified_sketch(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row per non-empty set: the least shingle of each of BANDS * ROWS ranges; an empty range takes over the value
    of the first non-empty one on its own probe sequence, the same sequence for every set."""
    k = BANDS * ROWS
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = rows * k + ((shingles >> U(32)) * U(k) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    sketch = np.zeros((len(bounds) - 1) * k, np.uint64)
    filled = np.zeros(len(sketch), bool)
    sketch[cell[first]], filled[cell[first]] = shingles[first], True
    sketch, filled = sketch.reshape(-1, k), filled.reshape(-1, k)
    r, c = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    out = sketch.copy()
    for probe in _PROBE:
        if not len(r):
            return out
        hit = filled[r, probe[c]]
        out[r[hit], c[hit]] = sketch[r[hit], probe[c[hit]]]
        r, c = r[~hit], c[~hit]
    out[r, c] = sketch[r, np.argmax(filled, axis=1)[r]]
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_bytes(batch.column(1))
        for i, j in row_slices(offsets):
            shingles, bounds = shingle_sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            keys = np.zeros((2, j - i), np.uint64)
            bands = np.zeros((j - i, BANDS), np.uint64)
            if len(some):
                starts = bounds[:-1][some]
                keys[0, some] = np.add.reduceat(mix(shingles + U(1)), starts)
                keys[1, some] = np.add.reduceat(mix(shingles ^ U(0x5DEECE66D1234567)), starts)
                sketch = densified_sketch(shingles, bounds)[some].reshape(-1, BANDS, ROWS)
                bands[some] = mix((sketch * _BAND).sum(axis=2, dtype=np.uint64) + _BAND_OF)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array(sizes), signed(keys[0]), signed(keys[1]),
                pa.ListArray.from_arrays(pa.array(ends), signed(bands[some].ravel()))], ["node", "n", "key1", "key2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_bytes(batch.column(1))
        for i, j in row_slices(offsets):
            shingles, bounds = shingle_sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), signed(shingles))], ["node", "shingles"])


def _close_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Spark splits a hot side by itself."""
    first = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = first.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).filter(
        100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can reach the similarity, from (node, component, shingles).

    Every set lists its shingles from the rarest; two sets that are similar share one of the first
    n - ceil(percent / 100 * n) + 1. Shingles that occur once take their places in that prefix but give no pairs.
    """
    rows = sets.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = rows.join(often, "s")
    w = Window.partitionBy("node", "component").orderBy("df", "s")
    placed = shared.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("node", "component"))) \
        .withColumn("place", F.col("n") - F.col("shared") + F.row_number().over(w))
    prefix = placed.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) \
        .select("node", "component", "n", "s", "place")
    # a shingle whose sets are all of one component has nothing to pair
    mixed = prefix.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("s")
    prefix = prefix.join(mixed, "s", "left_semi")
    x, y = prefix.alias("x"), prefix.alias("y")
    # at the first shingle that a pair shares, what is left behind both places bounds the rest of the intersection
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    return x.join(y, F.col("x.s") == F.col("y.s")).filter(
        (F.col("x.component") < F.col("y.component")) & _close_sizes(F.col("x.n"), F.col("y.n"), percent)
        & ((100 + percent) * room >= percent * (F.col("x.n") + F.col("y.n")))) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key reachable over links), kept (the row's key is that least key).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a key are one document:
    their links add up, and all of them are kept or dropped together. A null key is linked with nothing, its
    component_id is null and it is kept. An empty table gives an empty result.
    """
    whole = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    rows = staged(whole.mapInArrow(_sketches, "node long, n long, key1 long, key2 long, bands array<long>"), "near-sketch")
    linkable = rows.filter("n > 0 AND node IS NOT NULL")
    classes = staged(linkable.groupBy("key1", "key2").agg(F.min("node").alias("rep"), F.max("node").alias("last"), F.first("n").alias("n"),
                                                          F.first("bands").alias("bands")), "near-classes")
    copies = linkable.select("key1", "key2", "node").join(
        classes.filter("rep <> last").select("key1", "key2", "rep"), ["key1", "key2"]).filter("node <> rep").select("node", "rep")
    members = staged(classes.select(F.col("rep").alias("node"), "n", F.explode("bands").alias("band")), "near-bands")
    buckets = members.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("most")) \
        .filter("hub.node <> most").select("band", "hub")
    crowded = staged(members.join(buckets, "band"), "near-crowded")
    stars = crowded.filter((F.col("node") != F.col("hub.node")) & _close_sizes(F.col("n"), F.col("hub.n"), percent)) \
        .select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = staged(stars, "near-stars")
    small = classes.filter(F.col("n") <= FEW).select(F.col("rep").alias("node"))
    wanted = crowded.select("node").union(small).distinct()
    sets = staged(whole.join(wanted, "node", "left_semi").mapInArrow(_sets, "node long, shingles array<long>"), "near-sets")
    links = staged(confirmed(stars, sets, percent), "near-links")
    labels = component_labels(links)
    component = F.coalesce("label", "node").alias("component")
    placed = crowded.select("band", "node").join(labels, "node", "left").select("band", "node", component)
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    open_small = small.join(labels, "node", "left").select("node", component)
    open_nodes = staged(placed.join(mixed, "band", "left_semi").select("node", "component").union(open_small).distinct(), "near-open")
    more = staged(prefix_pairs(sets.join(open_nodes, "node"), percent), "near-prefix")
    links = links.union(confirmed(more, sets, percent)).union(copies.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    final = component_labels(links)
    out = rows.join(final, "node", "left")
    found = F.coalesce("label", "node")
    return out.select(F.col("node").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"),
                      F.coalesce(found == F.col("node"), F.lit(True)).alias("kept"))
