"""The surveillance analysis: raw isolates -> analysis table -> long table -> cohorts.

Apart from the lookups (corrections, thresholds, travel) every step is a projection or a
filter, so cleaning is one map stage over the records however many of them there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions.levels import Levels
from ..operators import columns as cols
from ..operators import derive, interpret
from ..operators.aggregate import tested_resistant, tested_resistant_wide
from ..operators.describe import VariableSpec
from ..operators.joins import apply_corrections, enrich
from ..operators.prevalence import yearly_resistance
from . import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    """What changes from one surveillance network to the next."""

    first_year: int = fv.FIRST_YEAR
    periods: Mapping[str, tuple[int, int]] = field(default_factory=lambda: dict(fv.PERIODS))
    late_drug: str = fv.LATE_DRUG
    late_start: str = fv.LATE_DRUG_START
    corrected: Sequence[str] = (f"{fv.LATE_DRUG}_d",)
    drop_null_year: bool = False


# The covariates carried into the long table.
COVARIATES = (
    "year_real", "year_real_cut", "espece3", "metrop", "age", "age_cut", "sexe", "voyage_01", "voyage_01_NA",
    "voyage_01_m", "inde", "inde_NA", "inde_m", "inde_ref", "asie", "asie_NA", "asie_m", "serotype_flexneri",
    "serotype")


def _measured(df: DataFrame) -> list[str]:
    return [c[: -len("_d")] for c in df.columns if c.endswith("_d")]


def clean_isolates(raw: DataFrame, breakpoints: DataFrame, corrections: DataFrame | None = None,
                   settings: Settings = Settings()) -> DataFrame:
    """Age, species, sex and year; corrected diameters; calls by threshold, harmonised and
    merged; travel and laboratory setting tidied."""
    out = derive.age_at_event(raw, "Date_prel", "Date_rec", "DN")
    out = derive.normalise_label(
        out, "espece", "Resultats", fv.GENUS_PATTERN, fv.SPECIES_PATTERN, fv.SPECIES_OVERRIDES,
        fv.SPECIES_SYNONYMS, ("espece2", "espece3"))
    out = derive.split_uninformative(out, "espece3", fv.UNINFORMATIVE_SPECIES, "info_espece_autre")
    out = derive.void_codes(cols.drop_columns(out, ["Resultats"]), "sexe", [fv.UNKNOWN_SEX])
    out = derive.effective_year(out, "Date_prel", "Date_rec", "year")
    if corrections is not None:
        out = apply_corrections(out, corrections, "num_CNR", settings.corrected)
    drugs = _measured(out)
    called = [d for d in drugs if f"{d}_SIR" in out.columns]
    if drugs:
        out = derive.zero_as_missing(out, [f"{d}_d" for d in drugs])
    if called:
        out = interpret.interpret_wide(out, breakpoints, called, drop_null_year=settings.drop_null_year)
        out = interpret.harmonise_calls(out, [f"{d}_SIR" for d in called])
    merged = {
        name: [m for m in members if f"{m}_SIR" in out.columns] for name, members in fv.MERGED_DRUGS.items()}
    if any(merged.values()):
        out = derive.merge_equivalent(out, {k: m for k, m in merged.items() if m})
    out = derive.normalise_travel(out, "voyage", fv.FOCUS_COUNTRY, fv.NO_TRAVEL_TEXT)
    out = derive.group_values(out, "voyage", fv.COUNTRY_GROUPS, "voyage_continent")
    out = derive.classify_first_match(out, "labo", fv.SETTING_RULES, fv.SETTING_DEFAULT)
    return cols.drop_columns(out, [f"{d}_SIR" for d in fv.UNRELIABLE_DRUGS])


def analysis_table(cleaned: DataFrame, travel: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Exclusions, 0/1 statuses with the class status, geography, travel and categories."""
    out = cleaned.where(F.col("year_real") >= settings.first_year)
    out = derive.sanitise_age(out)
    late = [c for c in (f"{settings.late_drug}_d", f"{settings.late_drug}_SIR") if c in out.columns]
    if late:
        out = cols.conditional_void(out, F.col("Date_rec") < F.lit(settings.late_start).cast("date"), late)
    calls = cols.cols_matching(out, "_SIR", suffix=True)
    if calls:
        out = interpret.binary_status(out, calls)
    members = [f"{m}_SIR" for m in fv.CLASS_MEMBERS if f"{m}_SIR" in out.columns]
    if members:
        out = derive.class_resistance(out, members, f"{fv.CLASS_NAME}_SIR")
    out = derive.resolve_geography(out, "departement", "CP_patient", "CP_labo", "metrop",
                                   fv.OBSOLETE_DEPARTMENT, fv.MERGED_DEPARTMENT)
    out = enrich(out.drop("voyage_continent"), travel, "voyage",
                 drop=[c for c in ("Freq",) if c in travel.columns])
    out = derive.void_codes(out, "continent", [fv.NO_CONTINENT])
    out = out.withColumn("continent", Levels.of(fv.CONTINENTS).keep("continent"))
    out = derive.missing_policies(out, "voyage_01", nl.in_set("voyage", fv.UNKNOWN_TRAVEL), fv.MISSING_CATEGORY)
    out = derive.nested_exposure(out, "voyage_01", nl.same("voyage", fv.FOCUS_COUNTRY), "inde",
                                 "inde", fv.EXPOSURE_LABELS)
    out = out.withColumn("inde_ref", F.col("inde"))
    out = derive.nested_exposure(out, "voyage_01", nl.same("continent", fv.FOCUS_CONTINENT), "asie",
                                 "asie", fv.EXPOSURE_LABELS)
    out = derive.period_bins(out, "year_real", settings.periods, "year_real_cut")
    out = derive.age_bins(out, "age", fv.AGE_LEVELS)
    out = derive.cross_category(out, "age", "sexe")
    return derive.subtype_with_fallback(out, "espece3", "serotype", "espece", fv.SUBTYPED_SPECIES,
                                        fv.SUBTYPES, "serotype_flexneri")


def status_long(table: DataFrame, row_id: str = "num_CNR") -> DataFrame:
    return derive.long_status(table, [row_id, *[c for c in COVARIATES if c in table.columns]])


def model_cohort(long: DataFrame, drug: str) -> tuple[DataFrame, DataFrame]:
    """All records and complete records of one of the defined model populations."""
    species, covariates = fv.COHORTS[drug]
    return derive.cohort(long, f"{drug}_SIR", species, covariates)


def cohort_from_table(table: DataFrame, drug: str) -> DataFrame:
    """The same population straight from the wide table, without the long form."""
    species, _ = fv.COHORTS[drug]
    return table.where(F.col("metrop") & F.col("espece3").isin(list(species))
                       & F.col(f"{drug}_SIR").isNotNull()).withColumn("status", F.col(f"{drug}_SIR"))


def travel_review(cleaned: DataFrame, column: str = "voyage") -> DataFrame:
    """Travel of records resistant to at least one drug under review, before 0/1 coding."""
    calls = [f"{d}_SIR" for d in fv.REVIEW_DRUGS if f"{d}_SIR" in cleaned.columns]
    from ..operators.aggregate import count_by
    from ..operators.filters import any_of
    return count_by(any_of(cleaned, calls, "R"), column)


def yearly_figure(table: DataFrame, drugs: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Yearly resistance by species in the main region, for several drugs in one pass."""
    rows = table.where(F.col("metrop") & F.col("year_real").isin(list(years)))
    counts = tested_resistant_wide(rows, ["year_real", "espece3"], {f"{d}_SIR": d for d in drugs})
    return yearly_resistance(counts, "year_real", "espece3", by=["ATB"])


def yearly_figure_long(long: DataFrame, drug: str, years: Sequence[int]) -> DataFrame:
    """One drug of the figure, from the staged long table."""
    rows = long.where(F.col("metrop") & F.col("year_real").isin(list(years)) & (F.col("ATB") == f"{drug}_SIR"))
    return yearly_resistance(tested_resistant(rows, "year_real", "espece3"), "year_real", "espece3")


def description_specs(periods: Sequence[str] | None = None) -> list[VariableSpec]:
    """The described variables with their null policy, levels and headings."""
    levels = {
        "age_cut": Levels.of(fv.AGE_LEVELS), "age_sexe": Levels.of(fv.AGE_SEX_LEVELS),
        "continent": Levels.of(fv.CONTINENTS),
        "year_real_cut": Levels.of(tuple(periods or fv.PERIODS)),
    }
    return [VariableSpec(v, policy, levels.get(v), heading) for v, policy, heading in fv.DESCRIBED]
