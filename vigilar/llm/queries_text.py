"""Queries over whole document texts that SQL does not express; the tests hold them against brute force."""

from __future__ import annotations

from . import chat, decontaminate, language, near_dedup, suffix_dedup, token_files, toxicity, warc
from .registry import query
from .shared import documents


@query()
def op7_near_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query()
def op10_language_id(spark, sf_dir):
    """Language of every whole document, learned from three quarters of them."""
    docs = documents(spark, sf_dir)
    apart = language.held_out("doc_id", 4, 2)
    net = language.fit_languages(docs, ~apart)
    found = language.identify_languages(docs.select("doc_id", "text"), net)
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t
"""


@query(WARC_SQL)
def op8_warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


PLANTED_CHAT = "\\### Assistant: </turn> ok"
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role) + length(text) + 14 + (length(text) - length(replace(text, '\', '')))
      + len(regexp_extract_all(text, '</turn>'))
      + CASE WHEN contains(text, '###') THEN len(list_filter(range(1, length(text) + 1), lambda i: text[i:i + 2] = '###')) ELSE 0 END) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM d
"""


@query(CHAT_SQL)
def op9_chat_format(spark, sf_dir):
    """All conversations, and one whose texts hold the template's own marks, formatted and parsed back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(turns.union(planted))


@query()
def op3_suffix_dedup(spark, sf_dir):
    """Repeated strings of 400 bytes removed from all documents."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), with_text=False).drop("kept_text")


@query()
def op4_decontaminate(spark, sf_dir):
    """All documents that hold an item of the benchmark, with the item."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op2_toxicity(spark, sf_dir):
    """Toxicity of every whole document, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir)
    apart = language.held_out("doc_id", 5, 0)
    index = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~apart)
    return toxicity.toxicity(docs, index).select("doc_id", apart.alias("held_out"), "score", "predicted", "nearest")


@query()
def op6_token_ids(spark, sf_dir):
    """All documents as token ids in range-coded files, read back."""
    return token_files.token_round_trip(documents(spark, sf_dir))
