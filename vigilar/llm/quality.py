"""Quality rules as weak supervision: rules vote good, bad or abstain, expectation-maximisation estimates how often each
rule votes so on good and on bad texts, and the posterior probability of quality decides. DataFrame functions only.

Rules overlap: what one takes for junk another one sees as well, from another side, and most vote good where they see none.
So a rule whose bad votes the others contradict weighs little, and a lone wrong vote is overruled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

BLANKS = " \t\n\u000b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STEPS = 20


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains. SQL over the measure columns."""
    name: str
    bad: str
    good: str


#: Each rule knows a range that is sure to be junk or prose, and abstains in between.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("letters", "100 * n_letters < 90 * word_chars", "100 * n_letters >= 95 * word_chars"),
    Rule("words", "word_chars > 7 * n_words OR word_chars < 4 * n_words", "10 * word_chars >= 45 * n_words AND 10 * word_chars <= 65 * n_words"),
    Rule("marks", "10 * n_marks > n_words", "25 * n_marks <= n_words"),
    Rule("capitals", "2 * n_upper > n_letters", "5 * n_upper <= n_letters"),
    Rule("lines", "10 * n_dup_lines > 2 * n_lines", "n_dup_lines = 0"),
    Rule("repeats", "10 * n_repeat_words > n_words", "50 * n_repeat_words <= n_words"),
    Rule("length", "n_words < 80", "n_words >= 100"),
)

#: Where the estimation starts: odds of a good text, of a good vote and of a bad vote.
START = (9.0, 1.25, 10.0)
#: Pseudo-votes of every rule among ten pseudo-texts of each class: good votes on good and bad texts, bad votes on bad and good
#: texts. They keep a rule from turning around and weigh nothing against thousands of texts.
PSEUDO = (5.0, 4.0, 4.0, 0.4)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _runs(ordered: str, mask: Column) -> Column:
    """Elements of a sorted array of (hash bits, position bits) whose hash bits a neighbour shares."""
    s = F.col(ordered)
    same = lambda x, y: F.coalesce((x.bitwiseXOR(y)).bitwiseAND(F.bitwise_not(mask)) == 0, F.lit(False))
    return F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | ((j > 0) & same(x, F.get(s, F.greatest(j - 1, F.lit(0))))))


def _packed(index: Column, mask: Column, a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(index.cast("long"))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, n_marks (long).

    Three-word windows are compared by 64-bit words whose low bits hold the position: sorting brings equal windows
    together. Windows that share a key with a neighbour are hashed once more with another order of the words, so what
    is left is repeated in the text. A null text has none of anything.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    out = docs.withColumn("__text", t).withColumn("__trimmed", trimmed)
    out = out.withColumn("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>"))
                         .otherwise(F.split("__trimmed", BLANK_RUN)))
    out = out.withColumn("__n", F.size("__words"))
    out = out.withColumn("__mask", F.expr("shiftleft(1L, cast(ceil(log2(__n + 2)) as int)) - 1L"))
    w, mask = F.col("__words"), F.col("__mask")
    index = F.sequence(F.lit(0), F.col("__n") - 3)
    first = F.transform(index, lambda i: _packed(i, mask, F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    none = F.expr("cast(array() as array<bigint>)")
    out = out.withColumn("__sorted", F.when(F.col("__n") < 3, none).otherwise(F.sort_array(first)))
    out = out.withColumn("__near", _runs("__sorted", mask))
    at = lambda x: x.bitwiseAND(mask).cast("int")
    again = F.transform("__near", lambda x: _packed(at(x), mask, F.get(w, at(x) + 2), F.get(w, at(x)), F.get(w, at(x) + 1)))
    out = out.withColumn("__again", F.when(F.size("__near") == 0, none).otherwise(F.sort_array(again)))
    out = out.withColumn("__places", F.when(F.size("__again") == 0, none).otherwise(
        F.sort_array(F.transform(_runs("__again", mask), lambda x: x.bitwiseAND(mask)))))
    p = F.col("__places")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long")))),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    s = F.col("__text")
    packed = _without(s, BLANKS)
    out = out.withColumns({
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(packed).cast("long"),
        "n_symbols": (F.length(s) - F.length(_without(s, SYMBOLS))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_letters": F.length(F.regexp_replace(s, r"[^\p{L}]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(s, r"[^\p{Lu}]+", "")).cast("long"),
        "n_marks": (F.length(s) - F.length(_without(s, "!?"))).cast("long"),
    })
    return out.drop("__text", "__trimmed", "__words", "__n", "__mask", "__sorted", "__near", "__again", "__places", "__lines")


def vote(rule: Rule) -> Column:
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END").cast("byte").alias(f"vote_{rule.name}")


def _posterior(weights: Column, votes: Column) -> Column:
    """Probability of quality: ``weights`` are the log odds of a good text, then of each rule's good vote, then of its bad vote;
    ``votes`` has 1 for every good vote cast, then -1 for every bad vote cast, else 0."""
    cast = F.zip_with(votes, F.slice(weights, 2, F.size(votes)), lambda v, w: v * w)
    return 1 / (1 + F.exp(-F.aggregate(cast, F.get(weights, 0), lambda s, x: s + x)))


def cast_votes(names: list[str]) -> Column:
    sides = [(n, side) for side in (1, -1) for n in names]
    return F.array(*[F.when(F.col(f"vote_{n}") == side, float(side)).otherwise(0.0) for n, side in sides])


def _reestimated(sums: Column, all_: Column, rules: int) -> Column:
    """New weights from ``sums`` (good texts, then good texts by vote) and ``all_`` (the same of all texts)."""
    good, bad = F.get(sums, 0), F.get(all_, 0) - F.get(sums, 0)
    weights = [F.log((good + 1) / (bad + 1))]
    for j in range(1, 2 * rules + 1):
        with_good, with_bad = F.get(sums, j), F.get(all_, j) - F.get(sums, j)
        if j <= rules:
            odds = ((with_good + PSEUDO[0]) / (good + 10)) / ((with_bad + PSEUDO[1]) / (bad + 10))
        else:
            odds = ((with_bad + PSEUDO[2]) / (bad + 10)) / ((with_good + PSEUDO[3]) / (good + 10))
        weights.append(F.log(odds))
    return F.array(*weights)


def fit_rules(voted: DataFrame, names: list[str], steps: int = STEPS) -> DataFrame:
    """One row ``weights`` (see ``_posterior``) from the votes on texts.

    The votes are counted by pattern, at most 3 ** rules of them whatever the number of texts, and the steps are a fold over
    that short list, so all of them are one job. A step takes the posterior of every pattern, counts the votes on
    texts of each class by it and re-estimates the share of good texts and every rule's two vote rates.
    """
    rules = len(names)
    counted = voted.groupBy(*[f"vote_{n}" for n in names]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    patterns = counted.agg(F.sort_array(F.collect_list(F.struct(cast_votes(names).alias("votes"), "n"))).alias("patterns"))
    zero = F.array(*[F.lit(0.0)] * (2 * rules + 1))

    def added(rows: Column, weight) -> Column:
        return F.aggregate(rows, zero, lambda s, r: F.zip_with(
            s, F.concat(F.array(F.lit(1.0)), F.transform(r["votes"], F.abs)), lambda a, b: a + b * weight(r)))

    def step(weights: Column) -> Column:
        judged = F.transform("patterns", lambda r: F.struct(r["votes"].alias("votes"), (r["n"] * _posterior(weights, r["votes"])).alias("n")))
        return F.get(F.transform(F.array(added(judged, lambda r: r["n"])), lambda sums: _reestimated(sums, F.col("all"), rules)), 0)

    start = [F.log(F.lit(x)) for x in (START[0], *[START[1]] * rules, *[START[2]] * rules)]
    whole = patterns.select("patterns", added(F.col("patterns"), lambda r: r["n"]).alias("all"))
    return whole.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*start), lambda w, i: step(w)).alias("weights"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
                  steps: int = STEPS, threshold: float = 0.5) -> DataFrame:
    """Per row: key, measures, base_failed, kept, quality (posterior probability), one vote column per rule.

    Fails the base when there are under 50 words or repeated windows cover over half of them; else kept follows the
    posterior. Null and empty texts have no words and fail the base. Rows are judged one by one, so repeated rows and
    repeated keys get equal results. An empty table gives an empty result.
    """
    names = [r.name for r in rules]
    measured = with_measures(docs.select(F.col(key), F.col(text).alias("__body")), "__body").drop("__body")
    voted = staged(measured.select("*", *[vote(r) for r in rules]), "quality-votes")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    weights = fit_rules(voted.filter(~failed), names, steps).scalar()  # rules are only asked about texts that pass the base
    judged = voted.withColumn("__weights", weights).withColumn("__quality", _posterior(F.col("__weights"), cast_votes(names)))
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                         (~failed & (F.col("__quality") >= threshold)).alias("kept"), F.round("__quality", 4).alias("quality"),
                         *[f"vote_{n}" for n in names])
