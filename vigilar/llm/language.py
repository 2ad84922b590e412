"""Language identification by a byte convolutional network in numpy: filters of several widths over byte classes, max
pooling, softmax. Trained on a bounded sample of labelled windows, applied to fixed-length windows of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import row_slices, text_bytes

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
SAMPLE_DOCS = 1200  # labelled documents per language that the fit looks at, on average
MAX_LANGUAGES = 500  # the most frequent ones are learned, so a soiled language column makes no endless network
SAMPLE_TOTAL = 20_000  # labelled documents of all languages that the fit looks at, on average
SAMPLE_WINDOWS = 3  # windows of each of them, spread evenly
EPOCHS = 14
BATCH = 128
CHUNK = 32  # windows classified at once

# byte classes: 0 padding, 1 digits, 2 blanks, 3 other ASCII, 4..29 letters without case, then the bytes from 128 on
CLASSES = 30 + 128
_CLASS = np.full(256, 3, np.int16)
_CLASS[48:58] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[65:91] = _CLASS[97:123] = np.arange(4, 30)
_CLASS[128:] = np.arange(30, CLASSES)


@dataclass
class Network:
    """``conv[w]``: (w, CLASSES, FILTERS); the pooled features of all widths go through ``out`` (features, languages)."""
    languages: list[str]
    conv: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width the responses to byte pairs (and a last single byte) by place, so a filter reads few tables."""
        out = {}
        for w, table in self.conv.items():
            pairs = [(j, (table[j][:, None] + table[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            out[w] = pairs + ([(w - 1, table[w - 1])] if w % 2 else [])
        return out

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter in every window (a column of ``x``), and its place."""
        best, where = [], []
        for w in WIDTHS:
            n = len(x) - w + 1
            r = self.conv[w][0].take(x[:n], axis=0)
            for j in range(1, w):
                r += self.conv[w][j].take(x[j:j + n], axis=0)
            at = r.argmax(axis=0)
            where.append(at)
            best.append(np.take_along_axis(r, at[None], 0)[0])
        return np.concatenate(best, axis=1), where

    def probabilities(self, x: np.ndarray, tables: dict[int, list[tuple[int, np.ndarray]]]) -> np.ndarray:
        """Of every window, a column of ``x``."""
        pair, best = x[:-1] * CLASSES + x[1:], []
        for w in WIDTHS:
            n = len(x) - w + 1
            r = None
            for j, table in tables[w]:
                part = table.take((pair if len(table) > CLASSES else x)[j:j + n], axis=0, mode="clip")
                r = part if r is None else np.add(r, part, out=r)
            best.append(r.max(axis=0))
        return softmax(np.maximum(np.concatenate(best, axis=1) + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: np.ndarray) -> np.ndarray:
    """Byte classes of a text as rows of WINDOW, the last one padded with 0; at least one row."""
    n = max(1, -(-len(raw) // WINDOW))
    x = np.zeros(n * WINDOW, np.int16)
    x[:len(raw)] = _CLASS[raw]
    return x.reshape(n, WINDOW)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Adam on cross-entropy. Through the max pooling only the winning place of each filter gets a gradient."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS * len(WIDTHS)
    net = Network(languages, {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(f, np.float32),
                  rng.normal(0, 0.2, (f, k)).astype(np.float32), np.zeros(k, np.float32))
    params = [*net.conv.values(), net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            xb, step = np.ascontiguousarray(x[rows].T), step + 1
            best, where = net.pooled(xb)
            hidden = np.maximum(best + net.bias, 0)
            wrong = softmax(hidden @ net.out + net.out_bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            back = (wrong @ net.out.T) * (hidden > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(net.conv[w])
                part = back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    seen = np.take_along_axis(xb, (where[i] + j).T, 0).T
                    np.add.at(g[j], (seen, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            rate = 0.01 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def labelled_windows(docs: DataFrame, learn: Column, key: str, text: str, lang: str, per_language: int) -> pd.DataFrame:
    """(lang, window bytes) of a bounded sample: about ``per_language`` documents of each of the MAX_LANGUAGES most frequent
    languages, SAMPLE_TOTAL at most, chosen by a hash of their key at a rate that follows the language's count, and up to
    SAMPLE_WINDOWS windows of each."""
    usable = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)) \
        .select(F.col(key), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    wanted = min(per_language, SAMPLE_TOTAL / max(1, len(counts)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], wanted / r["n"]) for r in counts], "lang string, rate double")
    place = F.pmod(F.xxhash64(key, "text"), F.lit(1_000_000)) / 1e6
    chosen = usable.join(F.broadcast(rates), "lang").filter(place < F.col("rate")).select("lang", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, parts = [], []
            for lg, t in zip(batch["lang"], batch["text"]):
                raw = t.encode()
                n = -(-len(raw) // WINDOW)
                for i in np.unique(np.linspace(0, n - 1, SAMPLE_WINDOWS).astype(int)):
                    langs.append(lg)
                    parts.append(raw[i * WINDOW:(i + 1) * WINDOW])
            yield pd.DataFrame({"lang": langs, "part": parts})
    return chosen.mapInPandas(cut, "lang string, part binary").toPandas().sort_values(["lang", "part"], ignore_index=True)


def fit_languages(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  per_language: int = SAMPLE_DOCS) -> Network | None:
    """The network trained on rows where ``learn`` holds; None without labelled rows."""
    sample = labelled_windows(docs, learn, key, text, lang, per_language)
    if sample.empty:
        return None
    languages = sorted(sample["lang"].unique())
    x = np.concatenate([windows_of(np.frombuffer(p, np.uint8))[:1] for p in sample["part"]])
    y = sample["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    return train(x, y, languages)


def _row_scores(net: Network, tables: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean window probabilities of each row, weighted by the bytes a window holds."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    ends = np.cumsum(counts)
    total = np.zeros((len(sizes), len(net.languages)))
    row_of = np.repeat(np.arange(len(sizes)), counts)
    index = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    first = offsets[:-1][row_of] + index * WINDOW
    filled = np.clip(offsets[1:][row_of] - first, 0, WINDOW)
    classes = np.concatenate([_CLASS[buf], np.zeros(WINDOW, np.int16)])
    step = np.arange(WINDOW)[:, None]
    for at in range(0, len(first), CHUNK):
        part = slice(at, at + CHUNK)
        x = classes[first[None, part] + step].astype(np.int32)
        x[step >= filled[None, part]] = 0
        np.add.at(total, row_of[part], net.probabilities(x, tables) * np.maximum(1, filled[part, None]))
    return total / total.sum(axis=1, keepdims=True)


def identify_languages(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", unknown: str = "und") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1) added or replaced, from the text alone.

    Null texts and texts without a letter are ``unknown`` with score 0, and so is everything when there was nothing to
    learn from. Rows are judged one by one, whole; repeated rows get equal results. An empty table gives an empty result.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rest = docs.drop(text)  # a text goes to the workers once, and comes back in small batches
    schema = docs.select(*rest.columns, text).schema.add("lang_pred", "string").add("score", "double")
    at, names = len(rest.columns), schema.names

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables()
        for batch in batches:
            buf, offsets = text_bytes(batch.column(at))
            has_letters = batch.column(at + 1).to_numpy(zero_copy_only=False)
            for i, j in row_slices(offsets, 1 << 18):
                p = _row_scores(net, tables, buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                found = [net.languages[k] if m else unknown for m, k in zip(has_letters[i:j], p.argmax(axis=1))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:at + 1], pa.array(found, pa.string()),
                                                  pa.array(np.where(has_letters[i:j], p.max(axis=1), 0.0))], names)
    if net is None:
        return docs.select("*", F.lit(unknown).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.select(*rest.columns, text, lettered).mapInArrow(classify, schema).select(*docs.columns, "lang_pred", "score")


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
