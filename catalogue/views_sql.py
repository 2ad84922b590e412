"""The same views as SQL text."""

from __future__ import annotations

from vigilar.plans.fixed_values import COUNTRY_GROUPS

from .views import DRUGS, THRESHOLDS, TRAVEL


def _lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


_LINES = ", ".join(
    f"max(l_quantity) FILTER (l_linenumber = {i}) AS q_{d}, max(l_returnflag) FILTER (l_linenumber = {i}) AS f_{d}"
    for i, d in DRUGS.items())
_D = ", ".join(f"q_{d} - 1 AS {d}_d" for d in DRUGS.values())
_S = ", ".join(
    f"CASE f_{d} WHEN 'R' THEN 'R' WHEN 'A' THEN 'S' WHEN 'N' THEN '{'i' if i % 2 else 's*'}' END AS {d}_SIR"
    for i, d in DRUGS.items())

_COUNTRIES = " ".join(f"WHEN voyage IN ({', '.join(map(_lit, names))}) THEN '{group}'" for group, names in COUNTRY_GROUPS.items())
BREAKPOINTS = ("breakpoints AS (SELECT ATB, annee, CAST(seuil AS DOUBLE) AS seuil FROM (VALUES "
               + values(THRESHOLDS) + ") b(ATB, annee, seuil))")
TRAVEL_DIM = "travel AS (SELECT * FROM (VALUES " + values(TRAVEL) + ") t(voyage, Freq, continent, voyage_01))"

RAW = f"""
drug_lines AS (SELECT l_orderkey, {_LINES} FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS num_CNR, o_orderkey AS row_id, c_custkey AS person,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS Date_prel,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 - 2 AS INTEGER) END AS Date_rec,
    CASE WHEN c_custkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(c_custkey * 37 % 30000 - 200 AS INTEGER) END AS DN,
    CASE WHEN o_orderkey % 101 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
    CASE WHEN o_orderkey % 41 <> 0 THEN
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'Shigella sonnei'
           WHEN o_orderpriority = '2-HIGH' THEN 'Shigella flexneri 2a'
           WHEN o_orderpriority = '3-MEDIUM' THEN 'Shigella dysenteriae'
           WHEN o_orderpriority = '5-LOW' THEN 'Shigella flexneri'
           WHEN o_orderkey % 3 = 0 THEN 'Shigella Rough'
           WHEN o_orderkey % 3 = 1 THEN 'Shigella boydii' ELSE 'non agglutinable' END END AS espece,
    CASE WHEN o_orderkey % 29 = 0 THEN '97-10607' WHEN o_orderkey % 31 = 0 THEN 'type 1c'
         WHEN o_orderkey % 37 = 0 THEN 'Ewing' ELSE 'Shigella sonnei g' END AS Resultats,
    CASE o_orderkey % 5 WHEN 0 THEN '1b' WHEN 1 THEN '2a' WHEN 2 THEN '3a' WHEN 3 THEN '4c' END AS serotype,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE 'I' END AS sexe,
    r_name = 'EUROPE' AS metrop,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Selles' WHEN 'AUTOMOBILE' THEN 'Sang'
         WHEN 'FURNITURE' THEN 'Biopsie rectale' WHEN 'HOUSEHOLD' THEN 'Autre' END AS origine_prel,
    CASE n_nationkey % 6 WHEN 0 THEN 'CHU ' || n_name WHEN 1 THEN 'Institut ' || n_name
         WHEN 2 THEN 'Labo ' || n_name WHEN 3 THEN 'Clinique hospitaliere ' || n_name
         WHEN 4 THEN 'LIP ' || n_name END AS labo,
    CASE c_custkey % 10 WHEN 0 THEN 'Inde (Goa)' WHEN 1 THEN 'Pas de voyage' WHEN 2 THEN 'Maroc'
         WHEN 3 THEN 'Espagne' WHEN 4 THEN 'Non precise' WHEN 5 THEN 'Non renseigné'
         WHEN 6 THEN 'Thailande' WHEN 7 THEN 'pas de voyage' WHEN 8 THEN 'pas de voyage' END AS voyage,
    CASE o_orderkey % 4 WHEN 0 THEN '96' WHEN 1 THEN '978' WHEN 2 THEN '75' END AS departement,
    CASE WHEN o_orderkey % 7 = 0 THEN lpad(CAST(c_custkey * 7 % 95000 AS VARCHAR), 5, '0') END AS CP_patient,
    lpad(CAST(c_custkey * 11 % 98000 AS VARCHAR), 5, '0') AS CP_labo,
    {_D}, {_S}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN drug_lines ON o_orderkey = l_orderkey
)"""

# fixed values: the species pattern of vigilar/plans/fixed_values.py in this engine's syntax
SPECIES_RE = ("sonnei|nst|non.s.rotypable|[rR]ough|flexneri|non.agglutinable|dysenteriae|boydii|"
              "autoagglutinable|sp")

_CALL = ", ".join(
    f"""CASE upper(CASE WHEN b_{d}.ATB IS NULL THEN r.{d}_SIR WHEN b_{d}.seuil IS NULL THEN NULL
        WHEN nullif(r.{d}_d, 0) < b_{d}.seuil THEN 'R' WHEN nullif(r.{d}_d, 0) IS NOT NULL THEN 'S'
        ELSE r.{d}_SIR END) WHEN 'S' THEN 'S' WHEN 'S*' THEN 'S' WHEN 'R' THEN 'R' WHEN 'I' THEN 'R' END AS {d}_SIR"""
    for d in DRUGS.values())
_CUTS = " ".join(
    f"LEFT JOIN breakpoints b_{d} ON b_{d}.ATB = '{d}' AND b_{d}.annee = r.year" for d in DRUGS.values())
_DZ = ", ".join(f"nullif(r.{d}_d, 0) AS {d}_d" for d in DRUGS.values())

CLEAN = f"""{BREAKPOINTS}, {TRAVEL_DIM}, {RAW},
cl1 AS (
  SELECT r.* EXCLUDE ({', '.join(f'{d}_d, {d}_SIR' for d in DRUGS.values())}, espece, sexe, voyage, labo),
    {_DZ}, {_CALL},
    CAST(floor(date_diff('day', r.DN, coalesce(r.Date_prel, r.Date_rec)) / 365.25) AS INTEGER) AS age,
    coalesce(r.espece, r.Resultats) AS espece,
    CASE WHEN contains(r.Resultats, '97-10607') THEN 'dysenteriae' WHEN contains(r.Resultats, '1c') THEN 'flexneri'
         WHEN contains(r.Resultats, 'Ewing') THEN 'boydii'
         ELSE lower(nullif(regexp_extract(coalesce(r.espece, r.Resultats), '{SPECIES_RE}'), '')) END AS sp0,
    CASE WHEN r.sexe <> 'I' THEN r.sexe END AS sexe,
    coalesce(CAST(year(r.Date_prel) AS INTEGER), CAST(year(r.Date_rec) AS INTEGER), r.year) AS year_real,
    translate(replace(CASE WHEN contains(lower(r.voyage), 'inde') THEN 'inde' ELSE lower(r.voyage) END,
              'pas de voyage', 'aucun'), 'é', 'e') AS voyage,
    CASE WHEN regexp_matches(r.labo, '^CH|^GH|GCS|^H|^C.H.|(?i:^ho|h.sp|h.pit|^hô|facult.)') THEN 'hospitalise'
         WHEN regexp_matches(r.labo, '(?i:institu)|IP') THEN 'institut'
         WHEN r.labo IS NOT NULL THEN 'ville' END AS labo
  FROM raw r {_CUTS}
),
cl2 AS (
  SELECT * EXCLUDE (sp0, CAZ10_SIR),
    CASE WHEN sp0 = 'non agglutinable' THEN 'nst' ELSE sp0 END AS sp1, CAZ10_SIR AS CAZ1030_SIR,
    CASE {_COUNTRIES} ELSE voyage END AS voyage_continent
  FROM cl1
),
cleaned AS (
  SELECT * EXCLUDE (sp1),
    CASE WHEN sp1 IN ('nst', 'rough', 'autoagglutinable', 'sp') THEN sp1 END AS info_espece_autre,
    CASE WHEN sp1 NOT IN ('nst', 'rough', 'autoagglutinable', 'sp') THEN sp1 END AS espece3
  FROM cl2
)"""


def _bit(c: str) -> str:
    return f"CASE {c} WHEN 'S' THEN 0 WHEN 'R' THEN 1 END"


_PLAIN = ("CIP", "CTX", "CRO", "CAZ1030", "NAL", "GEN")
_LATE = "coalesce(c.Date_rec < DATE '1995-07-01', FALSE)"

ANALYSIS = f"""{CLEAN},
an1 AS (
  SELECT c.* EXCLUDE (age, DN, AZM_d, AZM_SIR, {', '.join(f'{d}_SIR' for d in _PLAIN)}, voyage_continent),
    CASE WHEN c.age >= 0 THEN c.age END AS age, CASE WHEN c.age >= 0 THEN c.DN END AS DN,
    CASE WHEN NOT {_LATE} THEN c.AZM_d END AS AZM_d, CASE WHEN NOT {_LATE} THEN {_bit('c.AZM_SIR')} END AS AZM_SIR,
    {', '.join(f'{_bit(f"c.{d}_SIR")} AS {d}_SIR' for d in _PLAIN)},
    CASE WHEN t.continent <> 'none' THEN t.continent END AS continent, t.voyage_01,
    left(coalesce(CP_patient, CP_labo), 3) AS code,
    CASE WHEN metrop = FALSE AND departement IS NULL THEN left(coalesce(CP_patient, CP_labo), 3)
         ELSE departement END AS dep0
  FROM cleaned c LEFT JOIN travel t ON c.voyage IS NOT DISTINCT FROM t.voyage
  WHERE c.year_real >= 1995
),
an2 AS (
  SELECT * EXCLUDE (code, dep0),
    greatest(CAZ1030_SIR, CTX_SIR, CRO_SIR) AS C3G_SIR,
    CASE WHEN CP_patient IS NOT NULL THEN code
         WHEN CASE WHEN dep0 = '96' THEN code ELSE dep0 END = '978' THEN '974'
         WHEN dep0 = '96' THEN code ELSE dep0 END AS departement_bis,
    CASE WHEN voyage IN ('non precise', 'non renseigne') THEN NULL ELSE voyage_01 END AS voyage_01_NA,
    CASE WHEN year_real BETWEEN 1995 AND 1996 THEN '1995_1996' WHEN year_real BETWEEN 1997 AND 1998 THEN '1997_1998'
         WHEN year_real BETWEEN 1999 AND 2001 THEN '1999_2001' END AS year_real_cut,
    CASE WHEN age < 15 THEN '< 15' WHEN age <= 49 THEN '15-49' WHEN age > 49 THEN '50 +' END AS age_cut,
    CASE WHEN sexe IN ('F', 'M') AND age IS NOT NULL THEN sexe || CASE WHEN age < 15 THEN '_14less'
         WHEN age < 50 THEN '_15to49' ELSE '_50plus' END END AS age_sexe,
    CASE WHEN espece3 = 'flexneri' THEN
      CASE WHEN serotype IN ('1b', '2a', '3a') THEN serotype WHEN serotype IS NOT NULL THEN 'others'
           WHEN contains(espece, '1b') THEN '1b' WHEN contains(espece, '2a') THEN '2a'
           WHEN contains(espece, '3a') THEN '3a' ELSE 'others' END END AS serotype_flexneri
  FROM an1
),
iso AS (
  SELECT *, coalesce(voyage_01_NA, 'missing_cat') AS voyage_01_m,
    CASE WHEN voyage = 'inde' THEN 'inde' WHEN voyage_01 = '0' THEN 'pas de voyage' WHEN voyage_01 = '1' THEN 'autres voyages' END AS inde,
    CASE WHEN voyage = 'inde' THEN 'inde' WHEN voyage_01_NA = '0' THEN 'pas de voyage' WHEN voyage_01_NA = '1' THEN 'autres voyages' END AS inde_NA,
    CASE WHEN voyage = 'inde' THEN 'inde' WHEN voyage_01_NA = '0' THEN 'pas de voyage' WHEN voyage_01_NA = '1' THEN 'autres voyages' ELSE 'missing_cat' END AS inde_m,
    CASE WHEN continent = 'asia' THEN 'asie' WHEN voyage_01 = '0' THEN 'pas de voyage' WHEN voyage_01 = '1' THEN 'autres voyages' END AS asie,
    CASE WHEN continent = 'asia' THEN 'asie' WHEN voyage_01_NA = '0' THEN 'pas de voyage' WHEN voyage_01_NA = '1' THEN 'autres voyages' END AS asie_NA,
    CASE WHEN continent = 'asia' THEN 'asie' WHEN voyage_01_NA = '0' THEN 'pas de voyage' WHEN voyage_01_NA = '1' THEN 'autres voyages' ELSE 'missing_cat' END AS asie_m
  FROM an2
)"""

ALL_STATUS = ("CIP_SIR", "AZM_SIR", "CTX_SIR", "CRO_SIR", "CAZ1030_SIR", "NAL_SIR", "GEN_SIR", "C3G_SIR")
LONG = ANALYSIS + ",\ndl AS (" + " UNION ALL ".join(
    f"SELECT row_id, year_real, year_real_cut, espece3, metrop, age, age_cut, sexe, voyage_01, voyage_01_NA, voyage_01_m, "
    f"inde, inde_NA, inde_m, asie, asie_NA, asie_m, serotype_flexneri, serotype, '{c}' AS ATB, {c} AS status "
    f"FROM iso WHERE {c} IS NOT NULL" for c in ALL_STATUS) + ")"
RESULTS = RAW + ",\ntst AS (" + " UNION ALL ".join(
    f"SELECT row_id, year, '{d}' AS ATB, {d}_d AS diam, {d}_SIR AS SIR FROM raw" for d in DRUGS.values()) + ")"
OUT = ("outc AS (SELECT doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS size "
       "FROM documents JOIN labels USING (doc_id))")


def pct(n: str, total: str, digits: int) -> str:
    """100 * n / total rounded half to even on exact integers, as a double; null if total is 0."""
    return f"({scaled(n, total, digits)}) / {float(10 ** digits)}"


def scaled(n: str, total: str, digits: int) -> str:
    num, den = f"(CAST({n} AS HUGEINT) * {10 ** (2 + digits)})", f"nullif(CAST({total} AS HUGEINT), 0)"
    q, r = f"({num} // {den})", f"({num} % {den})"
    return (f"CAST({q} + CASE WHEN 2 * {r} > {den} OR (2 * {r} = {den} AND {q} % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)")


def pct_text(n: str, total: str, digits: int) -> str:
    s = scaled(n, total, digits)
    unit = 10 ** digits
    return (f"regexp_replace(printf('%d.%0{digits}d', CAST(({s}) // {unit} AS BIGINT), CAST(({s}) % {unit} AS BIGINT)), "
            f"'\\.?0+$', '')")


def n_pct(n: str, total: str, digits: int = 1) -> str:
    return f"coalesce(CAST({n} AS VARCHAR) || ' (' || {pct_text(n, total, digits)} || ')', CAST({n} AS VARCHAR))"
