"""Queries of the two operators that use DataFrame functions only, with their SQL."""

from __future__ import annotations

from . import mixing, quality
from .registry import query
from .shared import documents

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 3 * source_size AS ceiling FROM per),
filled AS (SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS weight, CAST(ceiling AS DOUBLE) / ((place - 1) % 3 + 1) AS fill FROM weighted),
levels AS (SELECT *, CAST(sum(source_size) OVER () - (sum(ceiling) OVER f - ceiling) AS DOUBLE)
  / CAST(sum(weight) OVER () - (sum(weight) OVER f - weight) AS DOUBLE) AS level
  FROM filled WINDOW f AS (ORDER BY fill, place ROWS UNBOUNDED PRECEDING)),
line AS (SELECT arg_min(level, fill * 1000000 + place) AS level FROM levels WHERE level <= fill),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(ceiling AS DOUBLE), line.level * weight) AS target
  FROM filled CROSS JOIN line),
documents_sized AS (SELECT s.*, t.source_size, t.target FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents_sized CROSS JOIN (VALUES (0), (1), (2)) e(epoch)
  WHERE size > 0 AND epoch <= floor(target / source_size)),
queue AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY epoch, o ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish FROM copies),
sent AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, o ROWS UNBOUNDED PRECEDING) AS sent FROM queue),
taken AS (SELECT doc_id, count(*) AS n FROM sent WHERE sent <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, size * coalesce(n, 0) AS taken FROM documents_sized LEFT JOIN taken USING (doc_id)
"""


@query(MIX_SQL)
def op5_mix_sources(spark, sf_dir):
    """All documents mixed to weights 1, 2, 3 repeating over their sources, at most three epochs each."""
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _quality_sql(steps: int = quality.STEPS) -> str:
    names = [r.name for r in quality.RULES]
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS vote_{r.name}" for r in quality.RULES)
    counted = ", ".join(f"vote_{n}" for n in names)
    good_good, good_bad, bad_bad, bad_good = quality.PSEUDO

    def tally(n, side, q):
        return f"coalesce(sum(n * {q}) FILTER (vote_{n} = {side}), 0)"

    def posterior(table):
        odds = f"{table}.l0 + " + " + ".join(f"CASE vote_{n} WHEN 1 THEN {table}.s_{n} WHEN -1 THEN -{table}.t_{n} ELSE 0 END" for n in names)
        return f"1 / (1 + exp(-({odds})))"
    parts = ["f0 AS (SELECT " + ", ".join([f"ln({quality.START[0]}) AS l0", *[f"ln({quality.START[1]}) AS s_{n}, ln({quality.START[2]}) AS t_{n}" for n in names]]) + ")"]
    for k in range(steps):
        parts.append(f"q{k} AS MATERIALIZED (SELECT patterns.*, {posterior(f'f{k}')} AS q FROM patterns CROSS JOIN f{k})")
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT ln((coalesce(sum(n * q), 0) + 1) / (coalesce(sum(n * (1 - q)), 0) + 1)) AS l0, " + ", ".join(
            f"ln((({tally(n, 1, 'q')} + {good_good}) / (coalesce(sum(n * q), 0) + 10)) / (({tally(n, 1, '(1 - q)')} + {good_bad}) / (coalesce(sum(n * (1 - q)), 0) + 10))) AS s_{n}, "
            f"ln((({tally(n, -1, '(1 - q)')} + {bad_bad}) / (coalesce(sum(n * (1 - q)), 0) + 10)) / (({tally(n, -1, 'q')} + {bad_good}) / (coalesce(sum(n * q), 0) + 10))) AS t_{n}"
            for n in names) + f" FROM q{k})")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM windows),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again CROSS JOIN (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
split_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM split_lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measures AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_marks
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
v AS MATERIALIZED (SELECT *, {votes} FROM measures),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM v),
patterns AS MATERIALIZED (SELECT {counted}, CAST(count(*) AS DOUBLE) AS n FROM b WHERE NOT failed GROUP BY ALL),
{", ".join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND q >= 0.5 AS kept,
  round(q, 4) AS quality FROM (SELECT b.*, {posterior(f'f{steps}')} AS q FROM b CROSS JOIN f{steps})
"""


@query(_quality_sql())
def op1_quality_rules(spark, sf_dir):
    """Quality verdict of every whole document by weak supervision."""
    out = quality.quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
