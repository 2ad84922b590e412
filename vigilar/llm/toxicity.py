"""Toxicity from the nearest labelled examples by TF-IDF cosine over selected terms, with a block-max inverted index.

Examples are grouped into blocks; per term and block the index keeps the weights and their maximum. A document visits blocks
in the order of their upper bounds and stops once the bound is below its k-th best cosine, so the neighbours are exact within these terms:
TERMS are a feature selection, all other words of a text count as one coordinate.
Votes are weighted by distance and calibrated on the examples' own left-out votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import U, mix, row_slices, signed, text_bytes, word_hashes

MAX_EXAMPLES = 12_000  # labelled rows that the index is fitted on, on average: a sample by a hash of their key
TERMS = 256  # terms of the vocabulary
PREFIXES = (4, 5, 6, 7, 8)  # bytes; starts of longer words are terms as well
NEIGHBOURS = 25
BLOCK = 64  # examples
NEARNESS = 0.02  # added to a distance before it divides a vote
PER_WORD, PER_TEXT = 0.03, 0.1  # weight of the one term that stands for all words outside the vocabulary

_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U(32)


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, row) of all words without outer punctuation, case folded, and of their prefixes; words per row."""
    words, s, e, bounds = word_hashes(buf, offsets, True, _CORE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    value, hashes, rows = np.zeros(len(s), np.uint64), [words], [row]
    for k in range(max(PREFIXES)):
        value |= _LOWER[padded[s + k]] << U(8 * k)
        if k + 1 in PREFIXES:
            longer = e - s > k + 1
            hashes.append(mix(value[longer] ^ (U(k + 1) << U(59)) ^ U(0x5851F42D4C957F2D)))
            rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows), np.diff(bounds)


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    blocks: np.ndarray  # (blocks, TERMS + 1, BLOCK): unit vectors of the examples, term by term
    block_max: np.ndarray  # (blocks, TERMS + 1)
    good: np.ndarray  # per example, how many labelled rows with this vector are not toxic
    bad: np.ndarray
    key: np.ndarray  # the least of their keys
    steps: tuple[np.ndarray, np.ndarray]  # calibration: raw vote -> probability

    def vectors(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return unit_vectors(*counted(buf, offsets, self.terms), self.idf)


def counted(buf: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of each term by row, words by row)."""
    hashes, rows, n_words = terms_of(buf, offsets)
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = terms[place] == hashes
    flat = np.bincount(rows[hit] * len(terms) + place[hit], minlength=(len(offsets) - 1) * len(terms))
    return flat.reshape(-1, len(terms)), n_words


def unit_vectors(counts: np.ndarray, n_words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.concatenate([counts * idf, (PER_WORD * n_words + PER_TEXT)[:, None]], axis=1)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def nearest(index: Index, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(example, cosine) of the k best examples of each row of ``q``, -1 where there are fewer, by block upper bounds."""
    n, per = len(q), index.blocks.shape[2]
    best, where = np.full((n, k), -1.0, np.float32), np.full((n, k), -1, np.int64)
    bound = q @ index.block_max.T
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(n)
    for r in range(order.shape[1]):
        active = active[bound[active, order[active, r]] + 1e-6 > best[active, k - 1]]
        if not len(active):
            break
        block = order[active, r]
        by = np.argsort(block, kind="stable")
        active, block = active[by], block[by]
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, z in zip(cuts, np.append(cuts[1:], len(block))):
            b, rows = block[a], active[a:z]
            cosine = q[rows] @ index.blocks[b]
            ids = np.broadcast_to(np.arange(per) + b * per, cosine.shape)
            all_c = np.concatenate([best[rows], np.where(ids < len(index.good), cosine, -1)], axis=1)
            all_i = np.concatenate([where[rows], ids], axis=1)
            top = np.argsort(-all_c, axis=1, kind="stable")[:, :k]
            best[rows], where[rows] = np.take_along_axis(all_c, top, 1), np.take_along_axis(all_i, top, 1)
    where[best < 0] = -1
    return where, best


def votes(index: Index, where: np.ndarray, cosine: np.ndarray, own: np.ndarray | None = None, own_bad: np.ndarray | None = None) -> np.ndarray:
    """Share of toxic votes, one pseudo-vote at the overall rate. ``own`` leaves one row of that example out."""
    w = np.where(where >= 0, 1 / (NEARNESS + np.maximum(0, 1 - cosine)), 0)
    good, bad = index.good[where].astype(float), index.bad[where].astype(float)
    if own is not None:
        mine = where == own[:, None]
        bad -= mine & own_bad[:, None]
        good -= mine & ~own_bad[:, None]
    rate = index.bad.sum() / (index.bad.sum() + index.good.sum())
    return ((w * bad).sum(1) + rate) / ((w * (bad + good)).sum(1) + 1)


def monotone_steps(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean label by rising raw vote, as points to interpolate between."""
    order = np.argsort(raw, kind="stable")
    groups: list[list[float]] = []  # sum of raw, sum of labels, size
    for x, v in zip(raw[order], y[order]):
        groups.append([x, v, 1])
        while len(groups) > 1 and groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2]:
            last = groups.pop()
            groups[-1] = [a + b for a, b in zip(groups[-1], last)]
    x = np.array([g[0] / g[2] for g in groups])
    p = np.array([(g[1] + 0.5 * 0.02) / (g[2] + 0.02) for g in groups])
    return x, np.maximum.accumulate(p)


def _clustered(v: np.ndarray) -> np.ndarray:
    """Order that puts examples with the same strongest terms side by side, so block maxima are tight."""
    strong = np.argsort(-v[:, :-1], axis=1, kind="stable")[:, :3]
    strong[np.take_along_axis(v, strong, 1) <= 0] = -1
    return np.lexsort((v[:, -1], strong[:, 2], strong[:, 1], strong[:, 0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, bound: int) -> DataFrame:
    """(key, text, toxic) of a bounded sample of labelled rows. Conflicting labels of a key count as toxic."""
    usable = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()) \
        .groupBy(F.col(key).cast("long").alias("__k")).agg(F.max((F.col(label) == 1).cast("int")).alias("toxic"))
    n = usable.count()
    share = min(1.0, bound / max(1, n))
    chosen = usable.filter(F.pmod(F.xxhash64("__k"), F.lit(1_000_000)) < int(share * 1_000_000))
    text_of = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return text_of.join(F.broadcast(chosen), F.col("key") == F.col("__k")).select("key", "text", "toxic")  # bounded by the sample


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> term, documents by label that hold it, added up over each batch."""
    for batch in batches:
        buf, offsets = text_bytes(batch.column(0))
        toxic = batch.column(1).to_numpy().astype(bool)
        hashes, counts = [], []
        for i, j in row_slices(offsets):
            h, row, _ = terms_of(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            by = np.lexsort((row, h))
            h, row = h[by], row[by]
            first = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[:len(h)]
            h, row = h[first], row[first]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
            if len(start):
                hashes.append(h[start])
                counts.append(np.stack([np.add.reduceat(toxic[i:j][row].astype(np.int64), start), np.add.reduceat((~toxic[i:j][row]).astype(np.int64), start)]))
        if hashes:
            c = np.concatenate(counts, axis=1)
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(hashes)), pa.array(c[0]), pa.array(c[1])], ["term", "bad", "good"])


def telling_terms(sample: DataFrame, terms: int) -> np.ndarray:
    """Sorted hashes of the terms that most exceed their expected number of toxic documents (chi-square)."""
    per = sample.select("text", "toxic").mapInArrow(_term_counts, "term long, bad long, good long") \
        .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    size = sample.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"] or not size["bad"] or size["bad"] == size["n"]:
        return np.zeros(0, np.uint64)
    p = (F.col("bad") + F.col("good")) / size["n"]
    over = F.col("bad") - size["bad"] * p
    ranked = per.filter(F.col("bad") >= 5).filter(over > 0).withColumn("chi", over * over / (size["bad"] * p * (1 - p) + 1e-9))
    top = ranked.orderBy(F.desc("chi"), "term").limit(terms).select("term").collect()
    return np.sort(np.array([r["term"] for r in top], np.int64).view(np.uint64))


def document_frequencies(docs: DataFrame, text: str, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of documents, of all in ``docs``, that hold each term, and their number; one row per batch is added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(0))
            df = np.zeros(len(terms), np.int64)
            for i, j in row_slices(offsets):
                df += (counted(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], terms)[0] > 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms) + 1)), pa.array(np.append(df, batch.num_rows))], ["t", "df"])
    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        df[r["t"]] = r["df"]
    return df[:-1], int(df[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 bound: int = MAX_EXAMPLES, terms: int = TERMS) -> Index | None:
    """The index over a bounded sample of the labelled rows where ``learn`` holds; None if they hold no telling term."""
    sample = labelled_sample(docs, labels, learn, key, text, label, bound)
    vocabulary = telling_terms(sample, terms)
    if not len(vocabulary):
        return None
    df, n = document_frequencies(docs, text, vocabulary)
    idf = np.log((n + 1) / (df + 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets):
                c, words = counted(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(words.astype(np.int64)),
                     pa.array([x.astype(np.uint16 if x.max(initial=0) < 65536 else np.int64).astype("<u4").tobytes() for x in c], pa.binary())],
                    ["key", "toxic", "words", "counts"])
    rows = sample.mapInArrow(vectors, "key long, toxic int, words long, counts binary").toPandas().sort_values("key", ignore_index=True)
    counts = np.stack([np.frombuffer(x, "<u4") for x in rows["counts"]]).astype(np.int64)
    bad = rows["toxic"].to_numpy() == 1
    v = unit_vectors(counts, rows["words"].to_numpy(), idf)
    # rows without a term of the vocabulary are alike; so are equal vectors
    v, first, same = np.unique(v, axis=0, return_index=True, return_inverse=True)
    place = np.empty(len(v), np.int64)
    order = _clustered(v)
    place[order] = np.arange(len(v))
    same = place[same.ravel()]
    n_blocks = -(-len(v) // BLOCK)
    padded = np.zeros((n_blocks * BLOCK, v.shape[1]), np.float32)
    padded[:len(v)] = v[order]
    blocks = np.ascontiguousarray(padded.reshape(n_blocks, BLOCK, -1).transpose(0, 2, 1))
    index = Index(vocabulary, idf, blocks, blocks.max(axis=2), np.bincount(same[~bad], minlength=len(v)), np.bincount(same[bad], minlength=len(v)),
                  rows["key"].to_numpy()[first][order], (np.zeros(1), np.zeros(1)))
    raw = np.concatenate([votes(index, *nearest(index, padded[same[i:i + 512]], NEIGHBOURS), same[i:i + 512], bad[i:i + 512])
                          for i in range(0, len(same), 512)])
    index.steps = monotone_steps(raw, bad.astype(float))
    return index


def toxicity(docs: DataFrame, index: Index | None, key: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """Per row: key, score (0 to 1), predicted (1 if score >= 0.5), nearest (keys of the closest labelled examples).

    Scores come from the text alone. A null or empty text is scored like any text without a telling term; without an index
    every score is 0. Rows are scored one by one, whole; repeated rows get equal results; an empty table gives an empty result.
    """
    if index is None:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<long>").alias("nearest"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES and TERMS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets):
                q = idx.vectors(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                # texts without a telling term differ in nothing: one search serves them all
                plain = ~(q[:, :-1] > 0).any(axis=1)
                told = np.flatnonzero(~plain)
                if plain.any():
                    told = np.append(told, np.flatnonzero(plain)[0])
                where, cosine = nearest(idx, q[told], NEIGHBOURS)
                p = np.interp(votes(idx, where, cosine), *idx.steps)
                back = np.full(j - i, len(told) - 1)
                back[told] = np.arange(len(told))
                p, where = p[back], where[back][:, :evidence]
                ids = idx.key[where]
                ends = np.concatenate([[0], np.cumsum((where >= 0).sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[where >= 0]))], ["key", "score", "predicted", "nearest"])
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(score, "key long, score double, predicted int, nearest array<long>").withColumnRenamed("key", key)
