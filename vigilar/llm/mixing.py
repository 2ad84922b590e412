"""Mixing sources to target weights by weighted fair queueing.

Every copy of a shuffled document gets a virtual finish time: the words its source has sent so far divided by the
source's target. Copies are taken in the order of that time until the total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ranked, staged

GROUP_ROWS = 50_000  # rows that a task orders together, on average


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    one_line = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    n = F.when(one_line == "", 0).otherwise(F.length(one_line) - F.length(F.replace(one_line, F.lit(" "), F.lit(""))) + 1)
    return F.coalesce(n, F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, max_epochs: int) -> DataFrame:
    """(source, source_size, n_rows, target): weights 1, 2, 3 repeating by code point, null last, shares of all words,
    each at most ``max_epochs`` times the source's size, the excess shared among the others by weight.

    Sources are filled in the order of ceiling / weight: those before the first one that stays below its ceiling reach
    theirs, all others share what is left by weight. A source without words has target 0.
    """
    per = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    numbered = ranked(per, [source], {"place": F.lit(1).cast("long")}, "mix-sources")
    weighted = numbered.withColumn("weight", (F.col("place") - 1) % 3 + 1)
    weighted = weighted.withColumn("ceiling", F.col("source_size") * F.lit(max_epochs).cast("long"))
    weighted = weighted.withColumn("fill", F.col("ceiling").cast("double") / F.col("weight"))
    filled = staged(ranked(weighted, ["fill", "place"], {"ceilings": F.col("ceiling"), "weights": F.col("weight")}, "mix-fill"),
                    "mix-filled")
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total["size"] or 0) - (F.col("ceilings") - F.col("ceiling"))).cast("double") \
        / (F.lit(total["weight"] or 0) - (F.col("weights") - F.col("weight")))
    first = filled.withColumn("level", level).filter(F.col("level") <= F.col("fill")) \
        .agg(F.min_by("level", F.struct("fill", "place")).alias("level")).first()["level"]
    shared = F.lit(float("inf") if first is None else first) * F.col("weight")
    return filled.select(source, "source_size", "n_rows", F.least(F.col("ceiling").cast("double"), shared).alias("target"))


def shuffle_key(key: Column, epoch: Column, seed: int) -> Column:
    """The same pseudo-random text in every run and in every SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = 3,
                seed: int = 17, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row of ``docs``: key, source, size, source_size, target, taken (words taken, repeats counted), epochs, text_hash.

    A null text has size 0; a null source is a source of its own, the last one. Rows of size 0 take nothing. Rows that
    share a key are told apart by their text; equal rows share what their copies took. An empty table gives an empty
    result. A source, also one with most rows, is ordered in slices of the shuffle key whose number follows its row
    count; totals per slice are summed up in a small table, so no task orders a whole source.
    """
    base = staged(docs.select(F.col(key).alias("__key"), F.col(source).alias("__source"), word_count(F.col(text)).alias("size"),
                              F.xxhash64(F.col(text)).alias("__text")), "mix-sizes")
    targets = source_targets(base.select("__source", "size"), "__source", max_epochs)
    rows = base.join(targets.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    last_epoch = F.least(F.lit(max_epochs - 1), F.floor(F.try_divide("target", "source_size")).cast("int"))
    copies = rows.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), last_epoch)))
    copies = copies.withColumn("order", shuffle_key(F.col("__key"), F.col("epoch"), seed))
    n_slices = F.ceil(F.col("n_rows") / group_rows)
    # slices are ranges of the shuffle key: its first 8 hex digits scaled to the number of slices
    place = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * n_slices / 2.0 ** 32)
    copies = staged(copies.select("__key", "__source", "__text", "size", "target", "order",
                                  (F.col("epoch") * n_slices + place).cast("long").alias("slice")), "mix-copies")
    before = Window.partitionBy("__source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("__source", "slice").agg(F.sum("size").alias("part")).select(
        F.col("__source").alias("__s"), F.col("slice").alias("__slice"),
        F.coalesce(F.sum("part").over(before), F.lit(0)).alias("sent_before"))
    inside = Window.partitionBy("__source", "slice").orderBy("order", "__text").rowsBetween(Window.unboundedPreceding, 0)
    queued = copies.withColumn("in_slice", F.sum("size").over(inside)).join(
        starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("slice") == F.col("__slice")))
    n_stretches = max(1, copies.count() // group_rows)
    queued = queued.withColumn("finish", (F.col("sent_before") + F.col("in_slice")) / F.col("target"))
    queued = staged(queued.select("__key", "__source", "__text", "size", "order", "finish",
                                  F.floor(F.col("finish") * n_stretches).cast("long").alias("stretch")), "mix-queue")
    # words sent by all sources before each stretch of virtual time
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = queued.groupBy("stretch").agg(F.sum("size").alias("part")).select(
        F.col("stretch").alias("__stretch"), F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("all_before"))
    at = Window.partitionBy("stretch").orderBy("finish", "__source", "order", "__text").rowsBetween(Window.unboundedPreceding, 0)
    budget = base.agg(F.sum("size")).first()[0] or 0
    taken = queued.withColumn("in_stretch", F.sum("size").over(at)).join(totals, F.col("stretch") == F.col("__stretch")) \
        .filter(F.col("all_before") + F.col("in_stretch") <= budget) \
        .groupBy(F.col("__key").alias("__k"), F.col("__source").alias("__s"), F.col("__text").alias("__t")) \
        .agg(F.count(F.lit(1)).alias("n_taken"))
    # the n-th of equal rows gets every n-th copy
    same = Window.partitionBy("__key", "__source", "__text")
    ready = rows.withColumn("twin", F.row_number().over(same.orderBy("size"))).withColumn("twins", F.count(F.lit(1)).over(same))
    hit = ready.join(taken, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__source").eqNullSafe(F.col("__s"))
                     & (F.col("__text") == F.col("__t")), "left")
    share = F.floor((F.coalesce("n_taken", F.lit(0)) + F.col("twins") - F.col("twin")) / F.col("twins")).cast("long")
    return hit.select(F.col("__key").alias(key), F.col("__source").alias(source), "size", "source_size", "target",
                      (share * F.col("size")).alias("taken"), share.alias("epochs"), F.col("__text").alias("text_hash"))
