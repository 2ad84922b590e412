"""SQL for p-values and limits: chi-square tails, exact tests, exact limits and a logistic fit of three coefficients."""

from __future__ import annotations

from vigilar.operators import exact


def chi_tail(statistic: str, df: str) -> str:
    """Upper tail of chi-square: one minus the series of the regularized gamma function."""
    return (f"CASE WHEN {statistic} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 1500), lambda i: "
            f"exp(({df} / 2.0 + i) * ln({statistic} / 2) - {statistic} / 2 - lgamma({df} / 2.0 + i + 1))))) END")


def choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


def exact_p(cells: str, levels: int) -> str:
    """CTEs that end in exact_p (key, p): the exact test of every key of ``cells`` (key, s records, e events), for at most
    ``levels`` levels of two records and more. A plain sum over all partial tables, level by level, in the widths that define p."""
    last = levels + 1
    parts = [f"""xk AS (SELECT key, sum(s) AS t, least(sum(e), sum(s) - sum(e)) AS m FROM {cells} WHERE s > 0 GROUP BY key HAVING sum(e) > 0 AND sum(s) > sum(e) AND count(*) > 1),
  xr AS (SELECT key, s, FALSE AS alone, {choose('s', 'e')} AS seen FROM {cells} JOIN xk USING (key) WHERE s > 1
    UNION ALL SELECT key, count(*), TRUE, 0.0 FROM {cells} JOIN xk USING (key) WHERE s = 1 GROUP BY key),
  xp AS MATERIALIZED (SELECT key, CAST(s AS BIGINT) AS s, alone, CAST(m AS BIGINT) AS m, CAST(t AS BIGINT) AS t,
    {last} + 1 - row_number() OVER (PARTITION BY key ORDER BY s DESC, alone DESC, seen DESC) AS place FROM xr JOIN xk USING (key)),
  xw AS (SELECT key, CASE WHEN sum(ln(least(s, m) + 1.0)) - max(ln(least(s, m) + 1.0)) <= ln({exact.FEW}.0) THEN {exact.FINE!r} ELSE {exact.COARSE!r} END AS width FROM xp GROUP BY key),
  xl AS (SELECT key, sum(round(seen / width)) + {exact.TIE} / max(width) AS lim FROM xr JOIN xw USING (key) GROUP BY key),
  x0 AS (SELECT key, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS cell, CAST(1 AS DOUBLE) AS mass, m, t AS room, width FROM xk JOIN xw USING (key))"""]
    parts[0] = parts[0].replace("1 AS DOUBLE) AS mass, m, t AS room", "1 AS DOUBLE) AS mass, CAST(m AS BIGINT) AS m, CAST(t AS BIGINT) AS room")
    for k in range(1, last):
        parts.append(f"""x{k} AS MATERIALIZED (SELECT key, total + j AS total, cell + CASE WHEN alone THEN 0 ELSE CAST(round({choose('s', 'j')} / width) AS BIGINT) END AS cell,
    sum(mass * exp({choose('s', 'j')} + {choose('(room - s)', '(m - total - j)')} - {choose('room', '(m - total)')})) AS mass, m, room - s AS room, width
    FROM (SELECT x.*, coalesce(p.s, 0) AS s, coalesce(p.alone, FALSE) AS alone FROM x{k - 1} x LEFT JOIN xp p ON p.key IS NOT DISTINCT FROM x.key AND p.place = {k}) b,
    LATERAL (SELECT unnest(range(greatest(0, m - total - room + s), least(s, m - total) + 1)) AS j) q
    GROUP BY ALL HAVING sum(mass * exp({choose('s', 'j')} + {choose('(room - s)', '(m - total - j)')} - {choose('room', '(m - total)')})) > {exact.NEGLIGIBLE!r})""")
    parts.append(f"""exact_p AS (SELECT x.key, least(1.0, coalesce(sum(mass) FILTER (cell + CASE WHEN p.alone THEN 0 ELSE round({choose('p.s', '(x.m - total)')} / width) END <= lim), 0.0)) AS p
    FROM x{last - 1} x JOIN xp p ON p.key = x.key AND p.place = {last} JOIN xl ON xl.key = x.key GROUP BY x.key)""")
    return ",\n  ".join(parts)


def exact_limits(counts: str) -> str:
    """CTEs that end in exact_limits (x, n, low, high): the exact 95 % limits of every x of n in ``counts``, by halving."""
    def upper(p, lo, hi):
        return f"list_sum(list_transform(range({lo}, {hi}), lambda k: exp({choose('n', 'k')} + k * ln({p}) + (n - k) * ln(1 - {p}))))"
    return f"""halves(i, x, n, a, b, c, d) AS (SELECT 0, x, n, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    FROM (SELECT DISTINCT CAST(x AS BIGINT) AS x, CAST(n AS BIGINT) AS n FROM {counts} WHERE n > 0)
    UNION ALL SELECT i + 1, x, n, CASE WHEN x > 0 AND over THEN a ELSE u END, CASE WHEN x > 0 AND over THEN u ELSE b END,
      CASE WHEN x < n AND under THEN c ELSE w END, CASE WHEN x < n AND under THEN w ELSE d END
    FROM (SELECT *, (a + b) / 2 AS u, (c + d) / 2 AS w, x > 0 AND {upper('((a + b) / 2)', 'x', 'n + 1')} > 0.025 AS over,
      x < n AND {upper('((c + d) / 2)', '0', 'x + 1')} < 0.025 AS under FROM halves WHERE i < 52)),
  exact_limits AS (SELECT x, n, CASE WHEN x = 0 THEN 0.0 ELSE (a + b) / 2 END AS low, CASE WHEN x = n THEN 1.0 ELSE (c + d) / 2 END AS high FROM halves WHERE i = 52)"""


def pair_fit(patterns: str) -> str:
    """CTEs that end in pair_fit (b0, b1, b2, v1, v2, ll): Newton steps of y of n on two 0/1 columns x1, x2 of ``patterns``."""
    p = "(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))))"
    sums = f"""SELECT sum(y - n * {p}) AS s0, sum(x1 * (y - n * {p})) AS s1, sum(x2 * (y - n * {p})) AS s2, sum(n * {p} * (1 - {p})) AS i00, sum(x1 * n * {p} * (1 - {p})) AS i01,
      sum(x2 * n * {p} * (1 - {p})) AS i02, sum(x1 * x2 * n * {p} * (1 - {p})) AS i12, sum(y * ln({p}) + (n - y) * ln(1 - {p})) AS ll FROM {patterns}"""
    det = "(i00 * (i01 * i02 - i12 * i12) - i01 * (i01 * i02 - i12 * i02) + i02 * (i01 * i12 - i01 * i02))"
    cof = {"00": "(i01 * i02 - i12 * i12)", "01": "(i02 * i12 - i01 * i02)", "02": "(i01 * i12 - i01 * i02)", "11": "(i00 * i02 - i02 * i02)",
           "12": "(i01 * i02 - i00 * i12)", "22": "(i00 * i01 - i01 * i01)"}
    return f"""newton(i, b0, b1, b2) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    UNION ALL SELECT i + 1, b0 + ({cof['00']} * s0 + {cof['01']} * s1 + {cof['02']} * s2) / {det}, b1 + ({cof['01']} * s0 + {cof['11']} * s1 + {cof['12']} * s2) / {det},
      b2 + ({cof['02']} * s0 + {cof['12']} * s1 + {cof['22']} * s2) / {det} FROM newton, LATERAL ({sums}) q WHERE i < 15),
  pair_fit AS (SELECT b0, b1, b2, {cof['11']} / {det} AS v1, {cof['22']} / {det} AS v2, ll FROM newton, LATERAL ({sums}) q WHERE i = 15)"""


CHI2_95_1 = "3.841458820694124"


def profile_2x2(cells: str) -> str:
    """CTEs that end in profile_2x2 (a, b, c, d, low, high): profile limits of the log odds ratio of counts without a zero, by halving."""
    u = "(2 * exp(t) * (a + b) * (a + c) / (q + sqrt(greatest(q * q + 4 * (1 - exp(t)) * exp(t) * (a + b) * (a + c), 0))))"
    rise = (f"2 * (a * ln(a / greatest({u}, 1e-300)) + b * ln(b / greatest(a + b - {u}, 1e-300)) + c * ln(c / greatest(a + c - {u}, 1e-300)) "
            f"+ d * ln(d / greatest(d - a + {u}, 1e-300)))")
    return f"""sides(i, a, b, c, d, side, inside, outside) AS (SELECT 0, a, b, c, d, side, ln(a * d / (b * c)), ln(a * d / (b * c)) + side * 30 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    FROM (SELECT DISTINCT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM {cells} WHERE least(a, b, c, d) > 0), (VALUES (-1), (1)) s(side)
    UNION ALL SELECT i + 1, a, b, c, d, side, CASE WHEN far THEN inside ELSE t END, CASE WHEN far THEN t ELSE outside END
    FROM (SELECT *, {rise} > {CHI2_95_1} AS far FROM (SELECT *, d - a + exp(t) * (2 * a + b + c) AS q FROM (SELECT *, (inside + outside) / 2 AS t FROM sides WHERE i < 60)))),
  profile_2x2 AS (SELECT a, b, c, d, max(inside) FILTER (side = -1) AS low, max(inside) FILTER (side = 1) AS high FROM sides WHERE i = 60 GROUP BY ALL)"""


def pair_profile(patterns: str) -> str:
    """CTEs that end in pair_profile (j, low, high) after pair_fit: profile limits of both coefficients. The likelihood with one
    coefficient held is maximised by ten Newton steps over the others, then the interval of the limit is halved."""
    p = "(1 / (1 + exp(-(a0 + t * xj + a2 * xo))))"
    sums = f"""SELECT sum(y - n * {p}) AS s0, sum(xo * (y - n * {p})) AS s2, sum(n * {p} * (1 - {p})) AS i00, sum(xo * n * {p} * (1 - {p})) AS i02,
      sum(y * ln({p}) + (n - y) * ln(1 - {p})) AS now FROM (SELECT CASE j WHEN 1 THEN x1 ELSE x2 END AS xj, CASE j WHEN 1 THEN x2 ELSE x1 END AS xo, n, y FROM {patterns})"""
    return f"""held(i, j, side, inside, outside, a0, a2) AS (SELECT 0, j, side, CASE j WHEN 1 THEN b1 ELSE b2 END, CASE j WHEN 1 THEN b1 + side * 8 * sqrt(v1) ELSE b2 + side * 8 * sqrt(v2) END,
      b0, CASE j WHEN 1 THEN b2 ELSE b1 END FROM pair_fit, (VALUES (1), (2)) u(j), (VALUES (-1), (1)) s(side)
    UNION ALL SELECT i + 1, j, side, CASE WHEN i % 10 = 9 AND 2 * (ll - now) <= {CHI2_95_1} THEN t ELSE inside END, CASE WHEN i % 10 = 9 AND 2 * (ll - now) > {CHI2_95_1} THEN t ELSE outside END,
      a0 + (i02 * s0 - i02 * s2) / (i00 * i02 - i02 * i02), a2 + (i00 * s2 - i02 * s0) / (i00 * i02 - i02 * i02)
    FROM (SELECT *, (inside + outside) / 2 AS t FROM held WHERE i < 450) h, (SELECT ll FROM pair_fit) f, LATERAL ({sums}) q),
  pair_profile AS (SELECT j, max(inside) FILTER (side = -1) AS low, max(inside) FILTER (side = 1) AS high FROM held WHERE i = 450 GROUP BY j)"""


def number(x: str, digits: int = 2) -> str:
    """A number rounded half to even, without trailing zeros."""
    return f"regexp_replace(printf('%.{digits}f', round_even({x}, {digits})), '\\.?0+$', '')"


def interval(x: str, low: str, high: str) -> str:
    return f"{number(x)} || ' (' || coalesce({number(low)}, 'NA') || ' - ' || coalesce({number(high)}, 'NA') || ')'"


def p_text(p: str, bound: float | None = None) -> str:
    small = f"round_even({p}, 3) = 0" if bound is None else f"{p} <= {bound}"
    return f"CASE WHEN {small} THEN '<0.001' ELSE {number(p, 3)} END"


def association(ctes: str, long: str, keys: str, declared: dict[str, int] | None = None) -> str:
    """Chosen test and statistic per group, from a long (keys, level, y) table: CTEs that end in chosen (keys, n, n_levels, df,
    min_expected, test, statistic) and cell (keys, level, n1, n0). ``declared``: number of listed levels of a variable."""
    listed = "CASE variable " + " ".join(f"WHEN '{v}' THEN {n}" for v, n in declared.items()) + " ELSE 0 END" if declared else "0"
    return f"""{ctes}, lng AS ({long}),
  cell AS (SELECT {keys}, level, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM lng WHERE level IS NOT NULL AND y IS NOT NULL GROUP BY {keys}, level),
  m AS (SELECT *, n1 + n0 AS r, sum(n1) OVER (PARTITION BY {keys}) AS c1, sum(n0) OVER (PARTITION BY {keys}) AS c0 FROM cell),
  e AS (SELECT *, r * c1 / CAST(c1 + c0 AS DOUBLE) AS e1, r * c0 / CAST(c1 + c0 AS DOUBLE) AS e0 FROM m),
  q AS (SELECT {keys}, sum(r) AS n, CAST(count(*) AS INTEGER) AS n_levels, CASE WHEN count(*) < {listed} THEN 0.0 ELSE min(least(e1, e0)) END AS min_expected, max(c1) AS c1, max(c0) AS c0,
    sum(pow(n1 - e1, 2) / e1 + pow(n0 - e0, 2) / e0) AS plain,
    sum(pow(abs(n1 - e1) - least(0.5, abs(n1 - e1)), 2) * (1 / e1 + 1 / e0)) AS corrected FROM e GROUP BY {keys}),
  chosen AS (SELECT {keys}, n, n_levels, n_levels - 1 AS df, min_expected,
    CASE WHEN min_expected > 5 THEN 'chisq' WHEN min_expected > 3 THEN 'chisq corr' ELSE 'fisher' END AS test,
    CASE WHEN least(c1, c0) = 0 THEN NULL WHEN min_expected > 5 OR (min_expected > 3 AND n_levels > 2) THEN plain WHEN min_expected > 3 THEN corrected END AS statistic FROM q)"""


def association_p(ctes: str, long: str, keys: str, levels: int, declared: dict[str, int] | None = None) -> str:
    """The same with p: CTEs that end in tested (columns of chosen, p_value)."""
    key = " || '|' || ".join(k.strip() for k in keys.split(","))
    return f"""{association(ctes, long, keys, declared)},
  xc AS (SELECT {key} AS key, n1 + n0 AS s, n1 AS e FROM cell JOIN chosen USING ({keys}) WHERE test = 'fisher'),
  {exact_p('xc', levels)},
  tested AS (SELECT c.*, CASE WHEN test = 'fisher' THEN p WHEN df > 0 THEN {chi_tail('statistic', 'df')} END AS p_value FROM chosen c LEFT JOIN exact_p x ON x.key = {key})"""
