"""Resampling, window and phrase operators against brute force, on nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from brute import LOWER, WORD
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from vigilar.llm import collocations, resample, slices, window_dedup

DOCS = "doc_id long, text string, lang string, source string, n long, f long, score double, words string, chunk long, part int, rank int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(12)]
    passage = prose(rng, 40)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "one", texts[0], texts[0] + " more", "É ab-cd,12 ÀB\x01\x1f" * 30, "x" * 300_000, prose(rng, 60_000),
              "New York. new york; New\nYork new york " * 60, "a b a b a " * 120]
    out = [(i, t, ("en", None, "de", "und")[i % 4], "s", 1, 1, 0.5, "w", 1, 1, 1) for i, t in enumerate(texts)]
    return out + [out[3], (3, texts[4], "en", *out[0][3:]), (None, texts[0], "en", *out[0][3:]), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = FEATURE_WORD.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resampled(rows, target):
    """Sorted (doc_id, n_features, weight, score, rank) by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, features(r[1])[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for r in rows:
        w, f = features(r[1])
        gains = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in map(bucket, f)]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(w)])
    queue = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    ranks = {id(r): k for k, r in enumerate(queue[:25 * len(queue) // 100], 1)}
    return sorted(([*r[:4], ranks.get(id(r))] for r in out), key=str)


def test_resample_against_the_definition(spark, docs, rows, empty):
    target = [rows[1][1], "É ab cd", None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [list(r) for r in resample.resample(docs, bench).collect()]
    assert sorted(got, key=str) == resampled(rows, target)
    none = [list(r) for r in resample.resample(docs, bench.limit(0)).collect()]
    assert sorted(none, key=str) == resampled(rows, [])
    assert resample.resample(empty, bench).count() == 0


def test_checksums_go_on_from_any_state():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 48, 49, 500)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    state = np.array([zlib.crc32(b"before"[:k]) for k in range(6)], np.uint32)
    got = resample.crc_on(state, raw, ends - [len(t) for t in texts], ends)
    assert got.tolist() == [zlib.crc32(t, int(s)) for t, s in zip(texts, state)]


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "ab, cd " * 50 + "é" * 90 + "-z" * 40
    raw = np.frombuffer(text.encode(), np.uint8)
    split = pre_tokenizers.Split(Regex(resample.WORD), "removed", invert=True)
    whole = resample.word_offsets(raw, split)
    monkeypatch.setattr(resample, "AT_ONCE", 16)
    cut = resample.word_offsets(raw, split)
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0]) == 141


# ---------------------------------------------------------------- windows

def windows_removed(rows, width=13):
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    least = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - width + 1):
                g = tuple(w[k:k + width])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in texts:
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if least[tuple(w[k:k + width])] < i:
                    gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, shard", [(1 << 23, 1 << 20), (2_000, 500)])
def test_windows_against_brute_force(docs, rows, empty, chunk, shard):
    got = window_dedup.remove_repeated_windows(docs, chunk_bytes=chunk, shard_cells=shard)
    assert sorted(map(tuple, got.collect()), key=str) == windows_removed(rows)
    assert window_dedup.remove_repeated_windows(empty).count() == 0


def test_other_widths_and_names(spark, rows):
    named = spark.createDataFrame([(r[0], r[1]) for r in rows], "number long, body string")
    got = window_dedup.remove_repeated_windows(named, "number", "body", width=4, with_text=False)
    assert got.columns == ["number", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == [r[:4] for r in windows_removed(rows, 4)]


def test_the_sketch_looks_at_few_windows_exactly(spark, monkeypatch):
    """Merged counts never miss a repeated window, and let few others through."""
    rng = random.Random(9)
    shared = " ".join(str(rng.random()) for _ in range(50))
    texts = [(i, " ".join(str(rng.random()) for _ in range(400)) + (" " + shared if i % 10 == 0 else "")) for i in range(200)]
    asked = []
    real = window_dedup.staged

    def watched(df, label):
        out = real(df, label)
        if label == "window-least":
            asked.append(out.agg(F.sum("n")).first()[0])
        return out
    monkeypatch.setattr(window_dedup, "staged", watched)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = window_dedup.remove_repeated_windows(df, with_text=False).agg(F.sum("n_removed")).first()[0]
    assert got == 19 * 50
    assert asked[0] < 20 * 38 + 0.1 * 200 * 400  # of some 80,000 windows


def test_hashes_of_structured_strings():
    """Texts whose polynomial hashes agree whatever the base."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [t for n in (128, 256, 1024, 4096) for t in (a[:n], a[:n].translate(str.maketrans("ab", "ba")))] + ["a\0", "a", "\0a", "a" * 9, "a" * 8 + "\0"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = slices.slice_hashes(raw, ends - [len(t) for t in texts], ends)
    assert len(set(got.tolist())) == len(texts)


# ---------------------------------------------------------------- phrases

def phrases(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            c = counts.setdefault(lang, Counter())
            for n in range(1, longest + 1):
                c.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            cuts = [(math.floor(Fraction(1000 * a * totals[lang], c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, lo, r, totals[lang], -s) for i, (s, a, p, lo, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, longest, top", [(8, 5, 2000), (30, 3, 7)])
def test_phrases_against_brute_force(docs, rows, least, longest, top):
    got = sorted(map(tuple, collocations.collocations(docs, least=least, longest=longest, top=top).collect()))
    assert got == phrases(rows, least, longest, top) and got


def test_small_batches_and_ranges(docs, rows, monkeypatch):
    """Beginnings of a range's first phrase that lie in earlier ranges."""
    real = collocations.DataFrame.repartitionByRange
    monkeypatch.setattr(collocations.DataFrame, "repartitionByRange", lambda self, *cols: real(self, 60, *cols))
    got = sorted(map(tuple, collocations.collocations(docs, least=8, at_once=3000).collect()))
    assert got == phrases(rows, 8)


def test_no_phrases(docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.filter("doc_id = 18")).count() == 0


def test_scores_beyond_64_bits(spark):
    import pyarrow as pa
    big = 3 * 10 ** 12
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"]), pa.array([["a", "b", "c"]]), pa.array([big - 1]), pa.array([[big, big + 7]]), pa.array([[big + 1, big + 5]]), pa.array([10 ** 13])],
        ["lang", "words", "f", "counts", "rights", "n"])
    out = next(collocations._scores(iter([batch]))).to_pylist()[0]
    cuts = [(1000 * (big - 1) * 10 ** 13 // (big * (big + 5)), 1, big, big + 5), (1000 * (big - 1) * 10 ** 13 // ((big + 7) * (big + 1)), 2, big + 7, big + 1)]
    score, _, lo, r = min(cuts)
    assert (out["score"], out["l"], out["r"], out["phrase"]) == (score, lo, r, "a b c")
