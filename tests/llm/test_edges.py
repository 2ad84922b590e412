"""Every dealt operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and
columns whose names clash with those the operators use."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vigilar.llm import chat, components, decontaminate, language, mixing, near_dedup, quality, suffix_dedup, token_files, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row string, node string, label int"


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [words(rng, 120) for _ in range(6)]
    texts += [None, "", " \n\t", "1 2 3 !!", texts[0], "the one long text " + words(rng, 150_000), "x" * 1_200_000, "a,b. C d"]
    out = [(i, t, None if i % 5 == 4 else "en", None if i % 4 == 3 else f"s{i % 3}", None, 0.5, 1, "r", "n", 1) for i, t in enumerate(texts)]
    return out + [out[1], (None, texts[2], "en", "s0", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_rules(docs, empty, rows):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["n_words"] == 0:
            assert r["base_failed"] and not r["kept"] and r["word_chars"] == 0
    assert {r["n_words"] for r in got if r["doc_id"] == 12} == {1}
    assert quality.quality_rules(empty).count() == 0


def test_a_lone_wrong_vote_is_overruled_and_accuracies_are_learned(spark):
    """Rules a and b see the junk; c calls as many good texts bad as junk."""
    patterns = [((1, 1, 1), 900), ((1, 1, -1), 70), ((-1, -1, 1), 75), ((-1, -1, -1), 6), ((-1, 0, 1), 4), ((0, 1, 1), 30)]
    rows = [p for p, n in patterns for _ in range(n)]
    names = ["a", "b", "c"]
    voted = spark.createDataFrame(rows, ", ".join(f"vote_{n} byte" for n in names))
    weights = quality.fit_rules(voted, names).first()["weights"]
    for_good, for_bad = weights[1:4], weights[4:]
    assert min(for_bad[0], for_bad[1]) > 3 > 1 > abs(for_bad[2]) and min(for_good[0], for_good[1]) > for_good[2]
    judged = spark.createDataFrame([p for p, _ in patterns], voted.schema).select(
        "*", quality._posterior(F.array(*[F.lit(w) for w in weights]), quality.cast_votes(names)).alias("q")).collect()
    kept = {tuple(r)[:3]: r["q"] >= 0.5 for r in judged}
    assert kept[1, 1, -1] and kept[0, 1, 1] and not kept[-1, -1, 1] and not kept[-1, -1, -1]
    assert quality.fit_rules(voted.limit(0), names).count() == 1


def test_repeated_windows_are_counted(spark):
    def plain(text):
        w = text.split()
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 3, 4, 9, 30, 200)] + ["a a a a", "a b c a b c", "a b c d"]
    got = quality.with_measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_mixing(docs, empty, rows):
    got = mixing.mix_sources(docs, group_rows=3).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert 0 < sum(r["taken"] for r in got) <= total
    assert mixing.mix_sources(empty).count() == 0
    again = mixing.mix_sources(docs.repartition(7), group_rows=100_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # neither layout nor group size matters


def test_mixing_stays_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "x " * rng.randrange(1, 60), "hot" if i % 3 else f"s{i % 11}") for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=100)
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    for r in per.collect():
        assert abs(r["taken"] - r["target"]) <= 180 and r["target"] <= 3 * r["size"] + 1e-6


def test_language(docs, empty, rows):
    net = language.fit_languages(docs, ~language.held_out("doc_id", 4, 2))
    got = language.identify_languages(docs, net)
    assert got.columns.count("score") == 1
    found = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [found[i]["lang_pred"] for i in (6, 7, 8, 9)] == ["und"] * 4 and found[6]["score"] == 0
    assert found[0]["lang_pred"] == "en" and language.identify_languages(empty, net).count() == 0
    none = language.fit_languages(empty, F.lit(True))
    assert none is None and {r["lang_pred"] for r in language.identify_languages(docs, none).collect()} == {"und"}


def test_language_sends_a_text_to_the_workers_once(spark, docs, monkeypatch):
    """Texts beside themselves in a batch are that many times the memory of an executor."""
    kind, sent = type(docs), []
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema, *more, **named: sent.append(df.schema) or whole(df, f, schema, *more, **named))
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns and got.schema["text"].dataType.simpleString() == "string"
    assert [s.json().count('"name":"text"') for s in sent] == [1]
    sent.clear()
    only = docs.select("text", "score")
    found = language.identify_languages(only, language.fit_languages(docs, F.lit(True)))
    assert found.columns == ["text", "lang_pred", "score"] and found.count() == docs.count()
    assert [s.json().count('"name":"text"') for s in sent] == [1]


def test_toxicity(spark, docs, empty, rows):
    rng = random.Random(2)
    train = [(i, words(rng, 40) + (" nasty brute " if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(5, 1, None), (None, 1, 1), (7, 0, 0)], LABELS)
    index = toxicity.fit_toxicity(spark.createDataFrame(train, "doc_id long, text string"), labels, F.lit(True))
    test = spark.createDataFrame([(1, "you nasty brute " + words(rng, 30)), (2, words(rng, 30)), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(test, index).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[3]["score"] == got[4]["score"]
    assert all(i % 4 == 0 for i in got[1]["nearest"])
    assert toxicity.toxicity(docs, index).count() == len(rows) and toxicity.toxicity(empty, index).count() == 0
    nothing = toxicity.fit_toxicity(empty, labels.limit(0), F.lit(True))
    assert nothing is None and toxicity.toxicity(docs, nothing).filter("score > 0").count() == 0


def test_nearest_examples_are_exact(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    v = rng.random((150, 9)).astype(np.float32) * (rng.random((150, 9)) < 0.3)
    v[:, -1] += 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    padded = np.zeros((192, 9), np.float32)
    padded[:150] = v
    blocks = np.ascontiguousarray(padded.reshape(3, 64, 9).transpose(0, 2, 1))
    index = toxicity.Index(None, None, blocks, blocks.max(axis=2), np.ones(150), np.ones(150), np.arange(150), None)
    q = v[rng.integers(0, 150, 40)]
    where, cosine = toxicity.nearest(index, q, 10)
    assert np.allclose(cosine, -np.sort(-(q @ v.T), axis=1)[:, :10], atol=1e-5)
    assert np.allclose((q[:, None] * v[where]).sum(2), cosine, atol=1e-5)


def test_a_soiled_language_column_stays_bounded(spark, monkeypatch):
    rows = [(i, f"text {i} with some words", f"v{i}" if i % 3 else "en") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "MAX_LANGUAGES", 5)
    sample = language.labelled_windows(df, F.lit(True), "doc_id", "text", "lang", 50)
    assert len(set(sample["lang"])) == 5 and (sample["lang"] == "en").sum() < 100


def test_decontamination(spark, docs, empty, rows):
    item = "Alice has 12 apples and gives Bob 5 apples, so how many apples does Alice have after 3 days of walking 7 km?"
    same = item.replace("Alice", "Zoe").replace("12", "40").replace("Bob", "Max")
    loose = item.replace("Bob", "Zoe", 1).replace("does Alice", "does Max").replace("12", "9").replace("gives", "sells")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, "five words are just enough")], BENCH)
    texts = [(100, "Before. " + item + " After."), (101, "Some text here. " + same + " More."), (102, "five words are just enough"), (103, loose), (104, None),
             (105, "Alice met Bob")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert {(100, 1), (101, 1), (102, 5)} <= set(got) and not {d for d, _ in got} & {104, 105}
    assert got[(100, 1)]["n_changed"] == 0 and got[(101, 1)]["n_changed"] == 3
    assert decontaminate.without_contaminated(docs, bench).count() == len(rows)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_fillers_have_to_map_one_to_one(spark):
    item = "then Ann saw Bea near Cleo and Dora with Eve by Fay at Gail for Hope in town"
    mixed = "then Ann saw Ann near Ann and Ann with Ann by Ann at Ann for Ann in town"
    bench = spark.createDataFrame([(1, item)], BENCH)
    docs = spark.createDataFrame([(1, item), (2, mixed)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()] == [1]


def test_names_that_open_sentences_are_placeholders(spark):
    item = "Tom has 5 apples. Sara has 3 pears. Tom gives Sara 2 apples. Sara eats 1 pear. Tom buys 4 more apples. How many apples does Tom have now?"
    other = item.replace("Tom", "Omar").replace("Sara", "Nina")
    accents = other.replace("Omar", "Ána").replace("Nina", "Олег")
    lines = "Tom met Sara near the old mill today.\nSara told Tom about the long way home."
    texts = [(1, other), (2, "Read this - " + other), (3, accents), (4, lines.replace("Tom", "Élie").replace("Sara", "Ольга")), (5, "Sara sat there. How many days?"),
             (6, other.replace(". How", ", so how"))]
    bench = spark.createDataFrame([(1, item), (2, lines)], BENCH)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)}
    assert got[1, 1]["item_tokens"] == got[1, 1]["found"] == 29 and got[1, 1]["n_changed"] == 2
    bench = spark.createDataFrame([(1, "Ann saw Bea near Cleo. Dora met with Eve by Fay. Gail was at Hope in town")], BENCH)
    docs = spark.createDataFrame([(1, "Ann saw Ann near Ann. Ann met with Ann by Ann. Ann was at Ann in town")], "doc_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0  # openers have to map one to one as well


def test_longer_names_and_spelled_numbers_are_placeholders(spark):
    item = "Tom has 5 apples. Sara has 3 pears. Tom gives Sara 2 apples. Sara eats 1 pear. Tom buys 4 more apples. How many apples does Tom have now?"
    full = item.replace("Tom", "Mary Ann").replace("Sara", "Lee Roy")
    spelled = item
    for digit, word in zip("53214", ("five", "twenty-three", "two", "one hundred", "four")):
        spelled = spelled.replace(digit, word)
    walk = "The train runs 120 km in 2 h and then it waits for $4 and 1/2 of the riders at the gate of the old town"
    tight = walk.replace("120 km", "95km").replace("2 h", "3h").replace("$4", "$17").replace("1/2", "½")
    texts = [(1, full), (2, spelled), (3, "Here: " + full.replace("5", "seven")), (4, tight), (5, item.replace("Tom", "When Bob"))]
    bench = spark.createDataFrame([(1, item), (2, walk)], BENCH)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 2)} <= set(got)
    assert got[1, 1]["found"] == got[1, 1]["item_tokens"] == 29 and got[1, 1]["n_changed"] == 2
    assert got[2, 1]["found"] == 29 and got[2, 1]["n_changed"] == 5 and got[4, 2]["found"] == got[4, 2]["item_tokens"]


def test_items_without_template_windows_are_found_verbatim(spark):
    items = [(1, "What is 12 * 7 + 5 - 3 ?"), (2, "Add 3 5 8 13 21 34 55 89 144"), (3, "Sort 4 9 2 7 1"), (4, "Who wrote Anna Karenina?"), (5, "Photosynthesis?"),
             (6, "Ann Bea Cleo Dora Eve Fay Gail Hope Iris"), (7, "?!"), (8, "")]
    docs = [(k, f"Some lines ahead of it, {t} and behind.") for k, t in items] + [
        (14, "asked who wrote anna karenina"), (16, "ann bea cleo dora eve fay gail hope iris"), (21, "What is 13 * 7 + 6 - 4 ?"), (22, "Add 1 2 3 4 5 6 7 8 9"),
        (23, "Sort 4 2 9 7 1"), (24, "Who wrote it, Anna Karenina?"), (26, "Bea Ann Cleo Eve Dora Fay Hope Gail Iris"), (27, None), (28, "Who wrote Anna"), (29, "Karenina?")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(1, 7)} | {(14, 4), (16, 6)}
    assert all(r["found"] == r["item_tokens"] and r["n_changed"] == 0 for r in got)


def test_long_texts_in_near_and_suffix_dedup(docs, rows):
    near = near_dedup.near_duplicates(docs).collect()
    assert len(near) == len(rows) and {r["component_id"] for r in near if r["doc_id"] == 10} == {0}
    cut = suffix_dedup.remove_repeats(docs).collect()
    assert len(cut) == len(rows)
    assert [r["kept_text"] for r in cut if r["doc_id"] == 12] == [""] and [r["n_spans"] for r in cut if r["doc_id"] == 12] == [1]


def test_near_stage_keeps_other_texts_of_an_id(spark):
    rows = [(1, "a b c d e f g", "s2"), (1, "a b c d e f g", "s1"), (1, "quite other words that stand here", "s0"), (1, None, "s0"), (2, "A b c d e f g", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 5):
        got = corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows[1:4]))


def test_near_stage_with_columns_that_have_no_order(spark):
    docs = spark.sql("SELECT * FROM VALUES (1, 'a b c d e f g', map('x', 1)), (1, 'a b c d e f g', map('x', 2)), (2, 'A b c d e f g', NULL), "
                     "(3, NULL, map('y', 3)) AS t(doc_id, text, tags)")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["tags"]) for r in got) == [(1, {"x": 1}), (3, {"y": 3})]


def test_token_files(spark, docs, empty, rows, tmp_path):
    got = token_files.token_round_trip(docs).orderBy("start").collect()
    encoder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    by = {r["doc_id"]: r for r in got}
    for key, text in want:
        if key is not None and len(text) < 5000:
            ids = encoder.encode(text, add_special_tokens=False).ids + [token_files.END_ID]
            assert by[key]["n_tokens"] == len(ids)
            assert by[key]["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert token_files.token_round_trip(empty).count() == 0


def test_special_strings_and_structured_texts_have_the_tokenizers_ids(spark):
    """The string of an added token, and two texts whose polynomial hashes agree."""
    a = "a"
    while len(a) < 256:
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [a, a.translate(str.maketrans("ab", "ba")), "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n<|endoftext|>\nz"]
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = token_files.token_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        ids = [*plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids, token_files.END_ID]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_range_coder(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(0)
    for n in (1, 2, 1025, 5000, 40_000):
        ids = np.minimum(rng.geometric(0.002, n), 60_000)
        ids[n // 2:] = ids[:n - n // 2]
        raw = token_files.encode_chunk(ids)
        back, end = token_files.decode_chunk(b"??" + raw, 2)
        assert (back == ids).all() and end == len(raw) + 2
    assert len(raw) < 2 * n
    for at in (30, len(raw) - 9):
        hurt = bytearray(raw)
        hurt[at] ^= 4
        with pytest.raises((ValueError, zlib.error)):
            token_files.decode_chunk(bytes(hurt))
    same = np.full(9000, 7)
    assert len(token_files.encode_chunk(same)) < 1500 and (token_files.decode_chunk(token_files.encode_chunk(same))[0] == 7).all()


def test_pieces_have_ids_of_their_own():
    import numpy as np
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, plain, rng = token_files.Encoder(path), Tokenizer.from_file(path), random.Random(6)
    pool = ["a", "é", " ", "\n", "\t", "'s", "7", " ", "　", ".", "<|endoftext|>", "日", "  ", "\r\n", " ", "ß"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, counts = encoder.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
    ends = np.cumsum(counts)
    for t, e, c in zip(texts, ends, counts):
        assert ids[e - c:e].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)

def test_a_word_is_one_piece_whatever_sign_follows():
    """Pieces end between an ASCII letter and a sign, and before words that begin with a wider letter; ids stay the tokenizer's."""
    import random
    import numpy as np
    from tokenizers import Tokenizer
    path = token_files.tokenizer_path(token_files.TOKENIZER)
    encoder, plain, rng = token_files.Encoder(path), Tokenizer.from_file(path), random.Random(8)

    def ids(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return encoder.ids(raw, np.array([0, len(raw)]))[0].tolist()
    text = "a lorem, lorem. lorem; (lorem) lorem- \u00e9lan \u00e8re \u00e9lan"
    assert ids(text) == plain.encode(text, add_special_tokens=False).ids
    assert {b" lorem", b",", b" \xc3\xa8re", b" \xc3\xa9lan"} <= set(encoder.known)
    assert not any(b"lorem" in p and p[-1:] in b",.;)-" for p in encoder.known)
    for _ in range(400):
        text = "".join(rng.choices("ab'st,._-\"1 \n  \u00e9\u00d7\u00f7\u00a0\u0378\u2003\u00b2\u0301\u07ff\t", k=rng.randrange(1, 60)))
        encoder.forget()
        assert ids(text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_worker_keeps_its_encoder_from_task_to_task(spark):
    import os
    import uuid
    import pandas as pd
    encoder_of, name = token_files._encoder, token_files.TOKENIZER

    def one(batches):
        for _ in batches:
            pass
        yield pd.DataFrame({"pid": [os.getpid()], "mark": [vars(encoder_of(name)).setdefault("mark", uuid.uuid4().hex)]})
    got = spark.range(0, 32, 1, 32).mapInPandas(one, "pid long, mark string").collect()
    assert len(got) == 32
    assert len({r["mark"] for r in got}) <= len({r["pid"] for r in got})


def test_a_worker_gives_back_what_its_task_freed(spark, tmp_path):
    import ctypes
    from pathlib import Path
    import pandas as pd
    import pyarrow as pa
    folder, name = f"{tmp_path}/tokens", token_files.TOKENIZER

    def one(batches):
        def resident():
            return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20
        for _ in batches:
            pass
        rng = random.Random(2)
        texts = [" ".join(f"{rng.randrange(10 ** 6):x}" for _ in range(5000)) for _ in range(350)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(350), pa.int64()), pa.array(texts)], ["doc", "text"])
        del texts
        made = [m.num_rows for m in token_files._writer(folder, name, 2)(iter([batch]))]
        left = resident()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pd.DataFrame({"files": made, "kept": [left - resident()]})
    got = spark.range(0, 1, 1, 1).mapInPandas(one, "files long, kept long").collect()
    assert got[0]["files"] == 1 and got[0]["kept"] < 30


def test_words_of_letters_and_forgotten_pieces_keep_the_tokenizers_ids(monkeypatch):
    """Words of letters are split at spaces by the library; letters and signs of all kinds beside them change no id, nor does
    what the encoder forgets."""
    import numpy as np
    path = token_files.tokenizer_path(token_files.TOKENIZER)
    encoder, plain, rng = token_files.Encoder(path), Tokenizer.from_file(path), random.Random(9)
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 300)
    assert encoder._kinds([b" word", " \u00e9lan\u027f".encode(), " a\u00d7".encode(), " a\u00f7b".encode(), " \u0391".encode(), b" a1", b"word",
                           b" ", "\u00e9".encode(), b" it's", b" a "]).tolist() == [2, 3, 1, 1, 1, 1, 0, 0, 0, 1, 0]
    letters = "abcdeXYZ\u00e9\u00c0\u0120\u0142\u024f\u027f\u00d7\u00f7\u0391\u0301\u00aa1'."
    words = ["".join(rng.choices(letters[:rng.choice([8, 14, len(letters)])], k=rng.randrange(1, 9))) for _ in range(900)]
    for _ in range(25):
        texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(12)]
        raw = [t.encode() for t in texts]
        ids, counts = encoder.ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert len(encoder.known) <= 300 + sum(len(t.split(" ")) for t in texts) * 3
        for t, e, c in zip(texts, np.cumsum(counts), counts):
            assert ids[e - c:e].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression):
    big = "<p>" + "é" * 900 + "</p>"
    rows = [(1, "http://a/1\r\nx", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 80),
            (7, "u", big + "!"), (7, "u", big + "!")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, page int, payload string")
    path = f"file://{tmp_path}/w-{compression}"
    warc.write_archives(pages, path, compression)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    kinds = {(r["page"], r["record_type"], r["refers_to"]) for r in got}
    assert (2, "response", None) in kinds and (1, "revisit", "<urn:vigilar:page:2>") in kinds and (None, "revisit", "<urn:vigilar:page:2>") in kinds
    assert {k[1] for k in kinds if k[0] in (3, 4, 5, 6, 7)} == {"response"}
    stored = {r["page"]: r for r in got if r["record_type"] == "response"}
    for page, url, html in rows:
        if page in stored and page != 1:
            assert bytes(stored[page]["payload"]).decode() == (html or "")
            assert stored[page]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
    assert {r["target_uri"] for r in got if r["page"] == 1} == {"http://a/1\r\nx"}
    some = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit'")
    assert some.count() == 2 and some.filter("payload IS NOT NULL").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip
    raw = [warc.record_bytes({"WARC-Type": t, "WARC-Record-ID": f"<x:{i}>"}, b"HTTP/1.1 200 OK\r\n\r\nbody" * (t == "response"))
           for i, t in enumerate(["warcinfo", "response", "request"])]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    (tmp_path / "w/b.warc").write_bytes(b"".join(raw))
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r["record_type"] for r in got) == sorted(["warcinfo", "response", "request"] * 2)
    assert [bytes(r["payload"]) for r in got if r["record_type"] == "response"] == [b"body"] * 2
    assert warc.read_archives(spark, f"file://{tmp_path}/w").filter("record_type = 'response'").count() == 2


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>\n", "\\", "\\\\", "####", "</turn", "", None, "é\n日", "a" * 300_000, "</turn>\n"]
    roles = ["user", "assistant", "system", None, "odd: \\role ###\n</turn>\n"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty), 1, "x") for c in [*range(40), None] for t in range(rng.randrange(1, 9))] + [(3, 0, "user", "again", 1, "x")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, formatted string")
    written = chat.format_chats(turns)
    order = lambda r: (r[1] is not None, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    got = {r["conv"]: r for r in written.collect()}
    assert len(got) == 41
    for c, r in got.items():
        mine = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=order)]
        assert chat.turns_of(r["formatted"]) == mine
        loss = [chat.unescaped(r["formatted"][a:b].encode()).decode() for a, b in zip(r["loss_from"], r["loss_to"])]
        assert loss == [t for role, t in mine if role == "assistant"]
    assert chat.round_trip(turns.limit(0)).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages(spark, docs, empty, at, tmp_path):
    name, stage = corpus_pipeline.STAGES[at]
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    if at < 4:
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert out.count() > 0
    assert stage(spark, empty, str(tmp_path)).count() == 0


def least_reachable(edges):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x
    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        least[hi] = lo
    return {x: root(x) for x in least if root(x) != x}


def test_components_take_few_small_plans(spark, monkeypatch):
    shuffles = []

    def watched(df, label):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return staged(df, label)
    staged = components.staged
    monkeypatch.setattr(components, "staged", watched)

    def labels(edges):
        shuffles.clear()
        got = components.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(got) == len({r["node"] for r in got})
        return {r["node"]: r["label"] for r in got}
    rng = random.Random(8)
    stars = [(7 * i + j, 7 * i) for i in range(40) for j in range(1, 7)]
    assert labels(stars) == least_reachable(stars)
    assert len(shuffles) == 1  # nothing is left to do, and no step is needed to see it
    hub = 5000
    mixed = [(hub, i) for i in range(100, 4000)] + [(i, i + 1) for i in range(6000, 6060)] + [(rng.randrange(7000, 7400), rng.randrange(7000, 7400)) for _ in range(300)]
    mixed += [(3, hub), (2, 100), mixed[0], mixed[0][::-1], (9, 9)]
    assert labels(mixed) == least_reachable(mixed)
    assert max(shuffles) <= 5  # a half step; both halves in one plan had more than twice as many
    assert labels(stars[:0]) == {}
