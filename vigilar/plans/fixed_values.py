"""Codes, word lists, patterns and labels that results must agree on."""

# Drugs of the main list in report order, and their display names.
MAIN_DRUGS = ("AMXAMP", "C3G", "NAL", "CIP", "STR", "AKN", "GEN", "SMX", "TMP", "SXT", "CHL", "TET", "AZM")
DISPLAY_NAMES = {"C3G": "3GC", "AMXAMP": "AMX/AMP"}

# Drugs of the susceptibility count table.
SUSCEPTIBILITY_DRUGS = ("AKN", "AMXAMP", "C3G", "CAZ1030", "CHL", "CIP", "CRO", "GEN", "NAL", "SMX", "STR",
                        "SXT", "TET", "TMP")

# Drugs reported under two names and never together: merged name -> sources.
MERGED_DRUGS = {"AMXAMP": ("AMX", "AMP"), "CAZ1030": ("CAZ10", "CAZ30")}
# Drug class: resistant to at least one member.
CLASS_NAME = "C3G"
CLASS_MEMBERS = ("CAZ1030", "CTX", "CRO")
# Drug without a reliable threshold.
UNRELIABLE_DRUGS = ("SPT",)
# The class and single drugs whose resistance triggers the travel review.
REVIEW_DRUGS = ("CAZ1030", "CTX", "CRO", "CIP", "AZM")
# Drug whose test is not valid for records received before this date.
LATE_DRUG = "AZM"
LATE_DRUG_START = "2014-04-01"

# Species extraction.
GENUS_PATTERN = "[Ss]higella"
SPECIES_PATTERN = ("sonnei|nst|non.s.rotypable|[rR]ough|flexneri|non.agglutinable|dysenteriae|boydii|"
                   "autoagglutinable|sp")
SPECIES_OVERRIDES = (("97-10607", "dysenteriae"), ("1c", "flexneri"), ("Ewing", "boydii"))
SPECIES_SYNONYMS = (("^non agglutinable$", "nst"), ("(?i)non s.rotypable", "nst"))
UNINFORMATIVE_SPECIES = ("nst", "rough", "autoagglutinable", "sp")
SUBTYPED_SPECIES = "flexneri"
SUBTYPES = ("1b", "2a", "3a")
UNKNOWN_SEX = "I"

# Travel.
FOCUS_COUNTRY = "inde"
NO_TRAVEL_TEXT = ("pas de voyage", "aucun")
COUNTRY_GROUPS = {
    "europe": ("allemagne", "espagne", "grece", "portugal", "suisse", "iles canaries", "italie"),
    "asie": ("asie", "thailande", "sri lanka", "cambodge", "chine", "inde", "myanmar", "nepal", "nepal,ind",
             "mongolie", "viet nam"),
    "maghreb": ("tunisie", "maroc", "algerie"),
}
UNKNOWN_TRAVEL = ("non precise", "non renseigne")
NO_CONTINENT = "none"
CONTINENTS = ("africa", "asia", "europe", "north america", "south america", "oceania", "unknown")
FOCUS_CONTINENT = "asia"
MISSING_CATEGORY = "missing_cat"
EXPOSURE_LABELS = {"0": "pas de voyage", "1": "autres voyages", "missing_cat": "missing_cat"}

# Setting of the sending laboratory: ordered rules on its name, then the default.
SETTING_RULES = (
    ("hospitalise", ("^CH", "^GH", "GCS", "^H", "^C.H.", "(?i)^ho", "(?i)h.sp", "(?i)h.pit", "(?iu)^hô",
                     "(?i)facult.")),
    ("institut", ("(?i)institu", "IP")),
)
SETTING_DEFAULT = "ville"

# Periods, age classes, age and sex classes.
PERIODS = {"2005_2008": (2005, 2008), "2009_2012": (2009, 2012), "2013_2016": (2013, 2016)}
AGE_LEVELS = ("< 15", "15-49", "50 +")
AGE_SEX_LEVELS = ("F_14less", "F_15to49", "F_50plus", "M_14less", "M_15to49", "M_50plus")
FIRST_YEAR = 2005

# Geography codes.
OBSOLETE_DEPARTMENT = "96"
MERGED_DEPARTMENT = ("978", "974")

# Specimen groups.
SPECIMEN_GROUPS = {
    "stool": ("selles",),
    "other digestive": ("anal", "anal/rectal", "biopsie colique", "biopsie rectale", "liquide gastrique"),
    "other": ("biopsie", "crachat", "liquide cephalo-rachidien", "peritoneal", "prelevement vaginal", "prothese",
              "pus", "sang", "urethral", "urines", "vaginal"),
    "undetermined": ("prelevement humain", "autre"),
}

# Free-text serotype labels.
SEROTYPE_TEXT_FIXES = (("6 boyd.. 88", "flexneri 6 boyd 88"), ("sonnei g", "sonnei g"))

# Described variables, null-line policy and report heading.
DESCRIBED = (
    ("metrop", "always", "N"),
    ("age_cut", "always", "Age (%)"),
    ("sexe", "always", "Sex (%)"),
    ("age_sexe", "always", "Age and sex category (%)"),
    ("espece3", "always", "Species (%)"),
    ("serotype_flexneri", "no", "Flexneri serotypes(%)"),
    ("labo", "always", "Origin of sample (%)"),
    ("voyage_01_m", "always", "Travel (%)"),
    ("continent", "no", "Travel continents (%)"),
    ("year_real_cut", "always", "Year of samples (%)"),
)
DESCRIBED_DRUGS = ("CIP", "C3G", "AZM")

# Model cohorts: drug, species, covariates.
COHORTS = {
    "AZM": (("sonnei", "flexneri"), ("age_cut", "sexe", "voyage_01_m", "espece3", "year_real")),
    "C3G": (("sonnei",), ("age_cut", "sexe", "voyage_01_m", "year_real_cut")),
    "CIP": (("sonnei", "flexneri"), ("age_cut", "sexe", "inde_m", "year_real_cut", "espece3")),
}

# MIC scales.
MIC_CENSOR_TEXT = "256"
MIC_CAP = 32.0
MIC_CAP_TEXT = "supeq32"
MIC_LEVELS_CIP = ("1", "2", "4", "8", "16", "32")
MIC_LEVELS_AZM = ("24", "32", "48", "64", "96", "128", "192", ">256")

# Grid bins of percent resistant.
GRID_BINS = (("0-25", 0, 25), ("25-50", 25, 50), ("50-75", 50, 75), ("75-100", 75, 100))
GRID_PERIODS = {"2005-2006": (2005, 2006), "2015-2016": (2015, 2016)}
