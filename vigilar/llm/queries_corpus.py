"""Queries that go by counts of words, windows and phrases over the whole corpus, with their SQL."""

from __future__ import annotations

from . import collocations, resample, window_dedup
from .registry import query
from .shared import documents

_CRC_SQL = """crc_table AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n))"""


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with crc_table in reach."""
    digit = lambda i: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {i}, 1)) - 1)"
    byte_list = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda i: CAST(16 * {digit('i')} + {digit('i + 1')} AS BIGINT))"
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {byte_list}), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), "
            "CAST(4294967295 AS BIGINT))")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _resample_sql() -> str:
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    k = resample.BUCKETS

    def features(name, table):
        return (f"{name} AS (SELECT id, w[i] AS f FROM {table}, unnest(range(1, len(w) + 1)) u(i) "
                f"UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM {table}, unnest(range(1, len(w))) u(i))")
    return f"""
WITH {_CRC_SQL}, dw AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
bw AS MATERIALIZED (SELECT 0 AS id, {words} AS w FROM benchmark),
{features('df', 'dw')}, {features('bf', 'bw')},
crcs AS MATERIALIZED (SELECT f, {_crc('f')} % {k} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
s AS (SELECT bucket, count(*) AS n FROM df JOIN crcs USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN crcs USING (f) GROUP BY bucket),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST((SELECT count(*) FROM df) + {k} AS DOUBLE)
  / ((coalesce(s.n, 0) + 1) * CAST((SELECT count(*) FROM bf) + {k} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({k})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
summed AS (SELECT id, count(*) AS n, sum(gain) AS g FROM df JOIN crcs USING (f) JOIN gains USING (bucket) GROUP BY id),
weighed AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
  CAST(CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS BIGINT) AS weight FROM dw LEFT JOIN summed USING (id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
  + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
queue AS (SELECT *, words >= {resample.SHORTEST} AS fits, row_number() OVER (PARTITION BY words >= {resample.SHORTEST} ORDER BY score DESC, doc_id) AS place,
  count(*) FILTER (words >= {resample.SHORTEST}) OVER () AS fitting FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= {resample.PERCENT} * fitting // 100 THEN place END AS rank FROM queue
"""


@query(_resample_sql())
def op11_importance_resample(spark, sf_dir):
    """A quarter of all documents, drawn towards the benchmark by hashed word and word-pair features."""
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _collocations_sql() -> str:
    longest, least = collocations.LONGEST, collocations.LEAST
    grams = " UNION ALL ".join(f"SELECT lang, w[i:i + {n - 1}] AS g FROM pieces, unnest(range(1, len(w) - {n - 2})) u(i) WHERE len(w) >= {n}"
                               for n in range(1, longest + 1))
    return rf"""
WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, CAST(count(*) AS HUGEINT) AS f FROM ({grams}) GROUP BY lang, g HAVING count(*) >= {least}),
longer AS (SELECT lang, g[2:] AS g, max(f) AS f FROM f WHERE len(g) > 2 GROUP BY ALL UNION ALL SELECT lang, g[:-2] AS g, max(f) FROM f WHERE len(g) > 2 GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN (SELECT lang, g, max(f) AS f FROM longer GROUP BY ALL) x ON x.lang = f.lang AND x.g = f.g
  WHERE len(f.g) >= 2 AND coalesce(x.f, 0) < f.f),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, lo.f AS l, r.f AS r, n, (1000 * c.f * n) // (lo.f * r.f) AS score FROM kept c, unnest(range(1, len(c.g))) u(k)
  JOIN f lo ON lo.lang = c.lang AND lo.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
scored AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {collocations.TOP}
"""


@query(_collocations_sql())
def op13_phrase_collocations(spark, sf_dir):
    """The strongest phrases of every language, from counts over all documents."""
    return collocations.collocations(documents(spark, sf_dir))


def _windows_sql(width: int = window_dedup.WIDTH) -> str:
    steps = ", ".join(f"({k})" for k in range(width))
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT id, doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {width - 2})) u(i) WHERE len(w) >= {width}),
least AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT id, i + k AS i FROM windows JOIN least USING (g), (VALUES {steps}) s(k) WHERE doc_id > m),
words AS (SELECT id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) u(i)),
kept AS (SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (id)
"""


@query(_windows_sql())
def op12_window_dedup(spark, sf_dir):
    """Windows of 13 words that an earlier document holds, removed from all documents."""
    return window_dedup.remove_repeated_windows(documents(spark, sf_dir), with_text=False)
