"""Derived clinical and epidemiological columns. All are narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions import text as tx
from .aggregate import collapse, proportions
from .columns import case_when, recode
from .joins import HOT_ROWS, attach_by_key


def age_at_event(df: DataFrame, primary: str, fallback: str, birth: str, name: str = "age") -> DataFrame:
    """Completed years from birth to the event date, or to the fallback date."""
    event = F.coalesce(F.to_date(primary), F.to_date(fallback))
    return df.withColumn(name, F.floor(F.datediff(event, F.to_date(birth)) / 365.25).cast("int"))


def sanitise_age(df: DataFrame, age: str = "age", birth: str = "DN") -> DataFrame:
    """A negative age is unknown, and so is the birth date of any record without an age."""
    valid = F.when(F.col(age) >= 0, F.col(age))
    return df.withColumns({age: valid, birth: F.when(valid.isNotNull(), F.col(birth))})


def effective_year(df: DataFrame, sampled: str, received: str, file_year: str,
                   name: str = "year_real") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.year(sampled), F.year(received), F.col(file_year)))


def void_codes(df: DataFrame, column: str, codes: Sequence) -> DataFrame:
    return df.withColumn(column, F.when(~nl.in_set(column, codes), F.col(column)))


def normalise_label(df: DataFrame, label: str, free_text: str, genus: str, pattern: str,
                    overrides: Sequence[tuple[str, str]], synonyms: Sequence[tuple[str, str]],
                    names: tuple[str, str]) -> DataFrame:
    """Genus and species from a free-text label.

    The free result stands in for a missing label; the species is the first of the ordered
    alternatives found; override texts in the free result win, in the given order; synonym
    patterns are folded last.

    Each step uses its input once: a filter on the species is pushed below these steps with
    the whole expression, which must not grow with every reference.
    """
    out = df.withColumn(label, F.coalesce(F.col(label), F.col(free_text)))
    species = case_when(*[(nl.matches(free_text, pat), value) for pat, value in overrides],
                        default=F.lower(nl.extract(label, pattern)))
    for synonym, value in synonyms:
        species = F.regexp_replace(species, synonym, value)
    return out.withColumns({names[0]: nl.extract(label, genus), names[1]: species})


def split_uninformative(df: DataFrame, column: str, values: Sequence[str], side: str) -> DataFrame:
    """Move values that name no category to a side column and void them in the main one."""
    vague = {v: v for v in values}
    informative = tx.replace_all(column, "^(?:" + "|".join(values) + ")$", "")
    return df.withColumns({side: nl.lookup(column, vague), column: F.nullif(informative, F.lit(""))})


def zero_as_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in cols})


def merge_equivalent(df: DataFrame, groups: Mapping[str, Sequence[str]], suffix: str = "_SIR") -> DataFrame:
    """One column per group of drugs that are never reported together."""
    out = df.withColumns({
        f"{name}{suffix}": F.coalesce(*[F.col(f"{m}{suffix}") for m in members])
        for name, members in groups.items()
    })
    return out.drop(*[f"{m}{suffix}" for members in groups.values() for m in members])


def class_resistance(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Resistant to at least one drug of the class; unknown only when all are unknown."""
    return df.withColumn(name, nl.any_positive(cols))


def normalise_travel(df: DataFrame, column: str, focus: str, no_travel: tuple[str, str]) -> DataFrame:
    """Lower case, one spelling of the focus country and of "no travel", no accents."""
    out = df.withColumn(column, F.lower(column))
    out = out.withColumn(column, F.when(F.contains(column, F.lit(focus)), F.lit(focus)).otherwise(F.col(column)))
    return out.withColumn(column, tx.fold_accents(F.replace(F.col(column), *[F.lit(t) for t in no_travel])))


def _by_value(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Value -> group; a value listed twice belongs to the first group."""
    out: dict[str, str] = {}
    for group, values in groups.items():
        for value in values:
            out.setdefault(value, group)
    return out


def group_values(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]], name: str) -> DataFrame:
    """Group name of the lists holding the value, else the value itself."""
    return df.withColumn(name, F.coalesce(nl.lookup(column, _by_value(groups)), F.col(column)))


def classify_first_match(df: DataFrame, column: str, rules: Sequence[tuple[str, Sequence[str]]],
                         default: str, name: str | None = None) -> DataFrame:
    """Class of the first rule with a matching pattern; other known texts take the default."""
    # one alternation per class; a group keeps inline flags to its own pattern
    branches = [
        (nl.matches(column, "|".join(f"(?:{p})" for p in patterns)), label) for label, patterns in rules
    ]
    branches.append((F.col(column).isNotNull(), default))
    return df.withColumn(name or column, case_when(*branches))


def resolve_geography(df: DataFrame, department: str, patient: str, laboratory: str, mainland: str,
                      obsolete: str, merged: tuple[str, str], name: str = "departement_bis") -> DataFrame:
    """Department from the recorded code and the postcodes.

    A known patient postcode wins. Otherwise the recorded department, completed overseas
    from the laboratory postcode; an obsolete code is replaced by it and one code is folded
    into another.
    """
    out = df.withColumn("__code", tx.part(F.coalesce(F.col(patient), F.col(laboratory)), 1, 3))
    code = F.col("__code")
    out = out.withColumn("__dep", F.when(nl.same(mainland, False), F.coalesce(F.col(department), code))
                         .otherwise(F.col(department)))
    out = out.withColumn("__dep", F.when(F.col("__dep") == obsolete, code).otherwise(F.col("__dep")))
    folded = F.when(F.col("__dep") == merged[0], F.lit(merged[1])).otherwise(F.col("__dep"))
    return out.withColumn(name, F.when(F.col(patient).isNotNull(), code).otherwise(folded)).drop(
        "__code", "__dep")


def missing_policies(df: DataFrame, column: str, unknown: Column, missing: str) -> DataFrame:
    """Variants of a 0/1 column: unknown as null (``_NA``), unknown as a category (``_m``)."""
    known = F.when(~F.coalesce(unknown, F.lit(False)), F.col(column))
    return df.withColumns({f"{column}_NA": known,
                           f"{column}_m": F.coalesce(known.cast("string"), F.lit(missing))})


def nested_exposure(df: DataFrame, base: str, focus: Column, name: str, focus_label: str,
                    labels: Mapping[str, str]) -> DataFrame:
    """None / other / focus, one column per missing policy of the base column.

    Makes ``name``, ``name_NA`` and ``name_m`` from ``base``, ``base_NA`` and ``base_m``.
    """
    out = df.withColumn("__focus", F.coalesce(focus, F.lit(False)))
    return out.withColumns({
        f"{name}{p}": F.when(F.col("__focus"), F.lit(focus_label)).otherwise(
            recode(F.col(f"{base}{p}").cast("string"), labels, default=None))
        for p in ("", "_NA", "_m")
    }).drop("__focus")


def focus_flag(df: DataFrame, column: str, focus: str, name: str) -> DataFrame:
    """Plain 0/1 flag; an unknown value counts as 0."""
    return df.withColumn(name, nl.same(column, focus).cast("int"))


def period_bins(df: DataFrame, year: str, edges: Mapping[str, tuple[int, int]], name: str) -> DataFrame:
    return df.withColumn(name, case_when(*[
        (F.col(year).between(lo, hi), label) for label, (lo, hi) in edges.items()]))


def age_bins(df: DataFrame, age: str, labels: Sequence[str], cuts: tuple[int, int] = (15, 50),
             name: str = "age_cut") -> DataFrame:
    a = F.col(age)
    return df.withColumn(name, case_when(
        (a < cuts[0], labels[0]), (a < cuts[1], labels[1]), (a >= cuts[1], labels[2])))


def cross_category(df: DataFrame, age: str, sex: str, sexes: Sequence[str] = ("F", "M"),
                   labels: Sequence[str] = ("14less", "15to49", "50plus"),
                   cuts: tuple[int, int] = (15, 50), name: str = "age_sexe") -> DataFrame:
    """Sex and age class in one label, known only when both are."""
    a = F.col(age)
    klass = case_when((a < cuts[0], labels[0]), (a < cuts[1], labels[1]), (a >= cuts[1], labels[2]))
    known = F.when(F.col(sex).isin(list(sexes)), F.col(sex))
    return df.withColumn(name, F.concat(known, F.lit("_"), klass))


def subtype_with_fallback(df: DataFrame, species: str, subtype: str, text: str, only: str,
                          kept: Sequence[str], name: str, other: str = "others") -> DataFrame:
    """Subtype of one species: kept values as they are, other known ones pooled, missing ones
    looked up in the species text; null for every other species."""
    recorded = F.when(nl.in_set(subtype, kept), F.col(subtype)).when(F.col(subtype).isNotNull(), F.lit(other))
    found = case_when(*[(nl.matches(text, k), k) for k in kept], default=other)
    return df.withColumn(name, F.when(nl.same(species, only), F.coalesce(recorded, found)))


def long_status(df: DataFrame, ids: Sequence[str], suffix: str = "_SIR", key: str = "ATB",
                value: str = "status") -> DataFrame:
    """(identifier and covariates, drug, status) for every known status."""
    drugs = [c for c in df.columns if c.endswith(suffix)]
    return df.unpivot(list(ids), drugs, key, value).where(F.col(value).isNotNull())


def cohort(long: DataFrame, drug: str, species: Sequence[str], covariates: Sequence[str],
           mainland: str = "metrop", species_col: str = "espece3", key: str = "ATB",
           status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Model population of a drug: all its records, and the ones with complete covariates."""
    everyone = long.where(
        F.col(mainland) & (F.col(key) == drug) & F.col(species_col).isin(list(species)))
    return everyone, everyone.na.drop(subset=[status, *covariates])


def person_key(df: DataFrame, cols: Sequence[str], name: str = "person_key") -> DataFrame:
    """Pseudonymous key of identifying columns; null when none of them is known."""
    known = reduce(or_, [F.col(c).isNotNull() for c in cols])
    joined = tx.paste(*cols, sep="\u001f", missing="")
    return df.withColumn(name, F.when(known, F.sha2(joined, 256)))


def flag_duplicates(df: DataFrame, person: str, same_cols: Sequence[str], row_id: str,
                    drop: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Persons with several records, and true duplicates among them.

    A true duplicate shares person and ``same_cols`` with a record of smaller ``row_id``.
    Counts come from one map-side combined aggregate over (person, signature); the join
    back salts hot persons. With ``drop`` only the first record of each duplicate set stays.
    """
    signature = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                        for c in same_cols])
    signed = df.withColumn("__sig", F.sha2(signature, 256))
    sets = signed.where(F.col(person).isNotNull()).groupBy(person, "__sig").agg(
        F.count(F.lit(1)).alias("n_same"), F.min(row_id).alias("__first"))
    people = sets.groupBy(person).agg(F.sum("n_same").alias("n_person"))
    sets = attach_by_key(sets, people, [person], "n_person", "__sig", hot_rows)
    out = attach_by_key(signed, sets, [person, "__sig"], "n_same", row_id, hot_rows)
    out = out.withColumn("is_repeat", F.coalesce(F.col(row_id) > F.col("__first"), F.lit(False)))
    out = out.drop("__sig", "__first")
    return out.where(~F.col("is_repeat")) if drop else out


def specimen_groups(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]],
                    undetermined: str = "undetermined", fallback: str = "unlisted") -> DataFrame:
    """Count and share per specimen group; unknown specimens are undetermined."""
    group = nl.lookup(F.lower(column), _by_value(groups))
    other = F.when(F.col(column).isNull(), undetermined).otherwise(fallback)
    labelled = df.select(F.coalesce(group, other).alias("specimen"))
    return proportions(labelled, "specimen")


def combined_label(df: DataFrame, species: str, subtype: str, plain: str, name: str = "label") -> DataFrame:
    """The plain species keeps its name; others show species_subtype."""
    joined = tx.paste(species, F.lit("_"), subtype)
    return df.withColumn(name, nl.if_else(F.col(species) == plain, F.col(species), joined))


def text_label_counts(df: DataFrame, column: str, remove: str,
                      fixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Frequencies of a free-text label, lower-cased, one word removed once, texts fixed."""
    low = F.lower(column)
    label = tx.replace_first(low, remove)
    for pattern, value in fixes:
        label = F.when(nl.matches(label, pattern), F.lit(value)).otherwise(label)
    known = df.where(F.col(column).isNotNull()).select(F.trim(label).alias("level"))
    return collapse(known, ["level"])


def censor_mic(df: DataFrame, column: str, name: str | None = None, censor: str = "256",
               cap: float | None = None, cap_text: str | None = None) -> DataFrame:
    """Numeric MIC from text: any text holding the censor value is that value, values at or
    over ``cap`` are the cap, and ``cap_text`` spells the cap."""
    c = F.col(column).cast("string")
    if cap_text is not None:
        c = F.when(nl.same(c, cap_text), F.lit(str(cap))).otherwise(c)
    value = F.when(nl.matches(c, censor), F.lit(float(censor))).otherwise(nl.number(c))
    if cap is not None:
        value = F.when(value > cap, F.lit(float(cap))).otherwise(value)
    return df.withColumn(name or column, value)


def mic_label(c: Column | str, censor: float = 256.0) -> Column:
    """Display label: the censored value shows as ``>256``, others without trailing zeros."""
    c = nl.col(c)
    plain = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.when(c == censor, F.concat(F.lit(">"), plain)).otherwise(plain)
