"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and is written as Parquet and read again before
the next one. All but the last return the columns of ``docs``. Every stage also serves empty tables, null texts and ids, and
repeated rows; what happens to them stands in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilar.llm.decontaminate import without_contaminated
from vigilar.llm.language import fit_languages, held_out, identify_languages
from vigilar.llm.mixing import mix_sources
from vigilar.llm.near_dedup import near_duplicates
from vigilar.llm.shared import documents, staged
from vigilar.llm.token_files import token_round_trip

SURE = 0.5  # least language score of a document that stays

#: The classifier, the tokenizer and the byte format are not expressible in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter go."""
    net = fit_languages(docs, ~held_out("doc_id", 4, 2))
    held = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("document"), "text")
    found = identify_languages(held, net)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("document.*", "text").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id. Rows without an id stay. Rows that share an id
    stay or go together; of those that also share the text one stays, the least by its other columns as JSON text, so columns
    of any type may be there.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = named.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("__rest")) \
        .select("doc_id", "text", "__rest.*")
    return named.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times. Equal rows share what they take, rounded up."""
    shares = mix_sources(docs).groupBy("doc_id", "source", "text_hash") \
        .agg(F.ceil(F.avg("epochs")).cast("int").alias("__epochs")).filter("__epochs > 0") \
        .select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), "__epochs")
    rows = docs.join(shares, docs["doc_id"].eqNullSafe(shares["__id"]) & docs["source"].eqNullSafe(shares["__source"])
                     & (F.xxhash64(docs["text"]) == shares["__hash"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__epochs"))).select(*[docs[c] for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files."""
    return token_round_trip(docs)


STAGES = [("language ID", language_id), ("near-duplicates", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("token ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
