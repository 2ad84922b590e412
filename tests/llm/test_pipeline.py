"""The pipeline against plain versions of its stages, and held-out accuracy of the two classifiers."""

import os
import zlib

import brute
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from vigilar.llm import token_files
from vigilar.llm.queries import QUERIES
from vigilar.llm.shared import documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_language_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.98 * len(got)
    bad = [r["score"] for r in got if r["toxic"] == 1]
    good = [r["score"] for r in got if r["toxic"] == 0]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good) >= 0.95


def test_decontamination_equals_word_windows(spark):
    """On these tables leaks are verbatim: documents that hold half of an item's eight-word windows."""
    import re

    def grams(text):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
    items = {r["item_id"]: grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in documents(spark, SF).collect():
        g = grams(r["text"])
        want |= {(r["doc_id"], i) for i, s in items.items() if s and 2 * len(g & s) >= len(s)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    assert got == want


def test_pipeline_equals_its_stages(spark):
    docs = documents(spark, SF)
    after = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, SF)
    rows = after.collect()
    assert len({r["doc_id"] for r in rows}) > 0.5 * docs.count()  # clean documents stay
    near = brute.near_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in rows} <= {k for k, v in near.items() if v[2]}
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    encoder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    at = 0
    for r, o in zip(sorted(rows, key=lambda r: r["doc_id"]), out, strict=True):
        ids = encoder.encode(r["text"] or "", add_special_tokens=False).ids + [token_files.END_ID]
        assert (o["doc_id"], o["start"], o["n_tokens"]) == (r["doc_id"], at, len(ids))
        at += len(ids)


def test_op6_equals_plain_encoding(spark):
    encoder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r["doc_id"]: r for r in QUERIES["op6_token_ids"](spark, SF).collect()}
    at = 0
    for r in documents(spark, SF).orderBy(F.col("doc_id")).collect():
        ids = encoder.encode(r["text"] or "", add_special_tokens=False).ids + [token_files.END_ID]
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
    assert not got


def test_quality_verdict_follows_the_labels(spark):
    """Among texts that pass the base; the labels are never an input."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("NOT base_failed").collect()
    assert sum(r["kept"] == (r["label"] == 1) for r in got) >= 0.98 * len(got)
    assert sum(not r["kept"] for r in got) > 0
