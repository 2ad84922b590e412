"""Text operators against brute force, and their edge cases."""

import os
import random

import pytest

import brute
from vigilar.llm import near_dedup, suffix_dedup
from vigilar.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df, key="doc_id"):
    return {r[key]: tuple(v for c, v in r.asDict().items() if c != key) for r in df.collect()}


def test_near_dedup_equals_brute_force(spark, texts):
    assert by_id(QUERIES["op7_near_dedup"](spark, SF)) == brute.near_components(texts)


def test_suffix_dedup_equals_brute_force(spark, texts):
    assert by_id(QUERIES["op3_suffix_dedup"](spark, SF)) == brute.removed_repeats(texts)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def family(rng):
    """Near copies of one base, chains, documents that share a passage, short and empty ones."""
    base, passage = words(rng, 200).split(), words(rng, 90)
    out = []
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        out.append(" ".join(w))
    step = words(rng, 120, 9999).split()
    for _ in range(12):  # neighbours are similar, the ends are not
        step = step[12:] + words(rng, 12, 9999).split()
        out.append(" ".join(step))
    out += [passage + " " + words(rng, rng.randrange(10, 120), 99999) for _ in range(25)]
    out += ["one two three", "One TWO three", "one two", "a b c d e f", "a b c d e g", None, "", " \n\t ", None, out[0], out[0]]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_on_planted_families(spark, seed):
    rows = list(enumerate(family(random.Random(seed))))
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.near_components(dict(rows))


def test_links_of_small_sets(spark):
    """Pairs of 3 of 4, 6 of 8, 12 of 16 and 24 of 32 shingles: sketches of small sets repeat few values and may share no band."""
    rng = random.Random(6)
    rows = [(0, "w347266 w2890432 w8885348 w4612595 w5889406 w2260790 w5822290 w1200785"), (1, "w347266 w2890432 w8885348 w4612595 w5889406 w2260790 w5822290")]
    for i in range(1, 4000):
        n = (8, 12, 20, 36)[i % 4]
        w = [f"w{rng.randrange(10 ** 7)}" for _ in range(n)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-(n - 4) // 4]))]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert [k for k, r in got.items() if r[1] != k // 2 * 2] == []


def test_a_crowd_of_small_near_copies_meets_once(spark):
    """Near copies of one short text are one component after the stars, so the exact join pairs none of them."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join([*base, f"x{rng.randrange(10 ** 6)}"])) for i in range(1500)] + [(5000 + i, f"{i} " + " ".join(base[:7])) for i in range(40)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert got == brute.near_components(dict(rows))


def test_near_dedup_edge_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "other words that are here now"), (2, "A b c d e f g"), (3, "other words that are here now"),
            (None, "a b c d e f g"), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == \
        [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("max_group", [suffix_dedup.MAX_GROUP, 3000])
def test_suffix_dedup_on_planted_passages(spark, max_group):
    rng = random.Random(4)
    passage, line = words(rng, 150, 9999), words(rng, 40, 9999) + "\n"
    texts = [words(rng, rng.randrange(0, 90), 99999) + " " + passage + " " + words(rng, 60, 99999) for _ in range(30)]
    texts += [line * 9, "a" * 1500, "ab" * 700, "é" * 450, passage[:399], passage[5:405], None, "", texts[0], texts[0][1:]]
    rows = list(enumerate(texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), max_group=max_group)
    assert by_id(got.drop("kept_text")) == brute.removed_repeats(dict(rows))


def test_suffix_dedup_edge_rows(spark):
    t = words(random.Random(1), 200, 9999)
    rows = [(1, t), (1, t), (None, t), (2, t[:500]), (3, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept_text"]) for r in got) == \
        [(0, len(t), ""), (1, len(t), ""), (1, len(t), ""), (2, 500, ""), (3, 0, "")]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_on_texts_whose_polynomial_hashes_agree(spark):
    """Two different texts of 400 bytes around a word and its complement, for several pairs of letters."""
    def twins(x, y, n):
        a = x
        while len(a) < n:
            a += a.translate(str.maketrans(x + y, y + x))
        return a, a.translate(str.maketrans(x + y, y + x))
    rng = random.Random(12)
    texts = []
    for pair in ("ab", "cd", "eg", "xz", "12", "AZ"):
        head, tail = ("".join(rng.choice("pqrst") for _ in range(72)) for _ in range(2))
        texts += [head + t + tail for t in twins(*pair, 256)] + [head + t + tail for t in twins(*pair, 1024)]
    rows = dict(enumerate(texts))
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), with_text=False).drop("kept_text"))
    assert got == brute.removed_repeats(rows)


def test_slice_hashes_modulo_a_prime():
    import numpy as np
    s = np.frombuffer(("abc" * 500).encode(), np.uint8)
    h = suffix_dedup._Prefixes61(s)
    assert h.of(np.array([0, 3, 6]), 300).tolist() == [h.of(np.array([0]), 300)[0]] * 3
    assert len(set(h.of(np.array([0, 1, 2]), 300).tolist())) == 3
    p = int(suffix_dedup.P61)
    rng = random.Random(1)
    a, b = [[rng.randrange(p) for _ in range(200)] for _ in range(2)]
    assert suffix_dedup._times61(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]


def test_suffix_dedup_compares_bytes_that_pairs_share_once():
    """Common prefixes by plain loops; ranges of one distance overlap, end at the text's end and hold zero bytes."""
    import numpy as np
    rng = random.Random(3)
    part = bytes(rng.choice(b"ab\0") for _ in range(900))
    other = bytearray(part)
    for at in (40, 300, 301, 650):
        other[at] = 122
    s = np.frombuffer(part + b"\xff" + bytes(other) + b"\xff" + b"a" * 500 + b"\0" * 9, np.uint8)

    def plain(x, y, depth):
        n = 0
        while n < depth and max(x, y) + n < len(s) and s[x + n] == s[y + n]:
            n += 1
        return n
    pairs = [(x, x + 901) for x in range(0, 900, 2)] + [(x, x + 1) for x in range(1800, 2310)] + \
        [tuple(sorted(rng.sample(range(len(s)), 2))) for _ in range(500)]
    rng.shuffle(pairs)
    a, b = np.array(pairs).T
    for depth in (5, 64, 400):
        want = np.array([plain(x, y, depth) for x, y in pairs])
        known = np.array([rng.randint(0, w) for w in want])
        assert suffix_dedup._common_prefix(s, suffix_dedup._words(s), a, b, known, depth).tolist() == want.tolist()
        order = np.array(sorted(range(len(s)), key=lambda i: s[i:i + depth].tobytes()))
        assert [s[i:i + depth].tobytes() for i in suffix_dedup.suffix_array(s, depth)] == [s[i:i + depth].tobytes() for i in order]
        assert suffix_dedup.adjacent_prefixes(s, order, depth).tolist() == [plain(x, y, depth) == depth for x, y in zip(order[:-1], order[1:])]
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(super().__getitem__(at))
    at = np.arange(850)
    found = suffix_dedup._next_difference(s.view(Counted), at, at + 400, np.full(850, 901))
    assert found.tolist() == [plain(x, x + 901, 400) for x in range(850)]
    assert sum(read) <= 2 * (850 + 400)  # 400 bytes and more for each pair, if each is compared on its own


def test_suffix_dedup_takes_short_rows_together(monkeypatch):
    """Segments of many rows at once are those of each row alone, and short rows share a pass."""
    import numpy as np
    import pyarrow as pa
    rng, passes, plain = random.Random(12), [], suffix_dedup._sliding_min
    sizes = [0, 1, 399, 400, 401, 0, 70_000, 400, 399, 2000] + [rng.randrange(0, 900) for _ in range(200)]
    texts = ["".join(rng.choices("ab é", k=n)) if n % 3 else "a" * n for n in sizes]
    want = [(r, *map(int, x)) for r, t in enumerate(texts)
            for x in zip(*[np.asarray(c).view(np.int64) for c in suffix_dedup.anchored_segments(np.frombuffer(t.encode(), np.uint8))])]
    monkeypatch.setattr(suffix_dedup, "_sliding_min", lambda x, w: passes.append(len(x)) or plain(x, w))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    got = [tuple(r.values()) for b in suffix_dedup._segments(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == sorted(want)
    assert len(passes) <= 20
