"""Phrase collocations from counts of 1 to 5 words, by sorted count streams that are merged in lockstep.

Texts are counted by tasks that sort numbered words, from short phrases to long ones: a longer phrase is only looked at where
all its word pairs are frequent, since no part of a frequent phrase is rarer than it. The frequent phrases form one stream
with their counts, which is kept in two orders. In prefix order a phrase follows its own beginnings, so a single pass with
the open beginnings at hand knows the count of each (left counts) and hands back the greatest count of a continuation. In
suffix order, by the words from the last to the first, the same pass does so for endings (right counts). Both passes come
back in prefix order and are merged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged
from .slices import slice_hashes, spread, word_bounds
from .textbytes import text_bytes

LONGEST = 5  # words of the longest phrase
LEAST = 100  # occurrences of a phrase
TOP = 2000  # phrases reported per language
AT_ONCE = 1 << 20  # bytes of text that a task counts together
FILTER_BITS = 26  # 8 MB, whatever the number of frequent pairs: a fuller filter lets more through, and loses nothing

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[9, 32]] = True
UNKNOWN = "und"


def piece_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all rows, row of each word, number of its piece). ``raw`` has its A-Z lowered."""
    start, end, row = word_bounds(raw, offsets, _BETWEEN)
    piece = np.cumsum(_BREAK[raw])[start] + row if len(start) else row
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    held = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    words = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(raw[held])])
    return words, row, piece


def _batches_of_text(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of about ``at_once`` bytes at a time, whole rows."""
    held, size = [], 0
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + at_once - size, "right")) - 1
            upto = min(batch.num_rows, max(upto, at + 1))
            held.append(batch.slice(at, upto - at))
            size += int(offsets[upto] - offsets[at])
            at = upto
            if size >= at_once:
                table = pa.Table.from_batches(held)
                yield table.column(0).combine_chunks(), table.column(1).combine_chunks()
                held, size = [], 0
    if held:
        table = pa.Table.from_batches(held)
        yield table.column(0).combine_chunks(), table.column(1).combine_chunks()


def _numbered(langs: pa.Array, texts: pa.Array):
    """(language names, vocabulary, language of each word, number of each word, piece of each word)."""
    raw, offsets = text_bytes(texts)
    words, row, piece = piece_words(_LOWER[raw], offsets)
    names = pc.dictionary_encode(langs)
    vocabulary = pc.dictionary_encode(words)
    lang = names.indices.to_numpy()[row].astype(np.int64)
    return names.dictionary, vocabulary.dictionary, lang, vocabulary.indices.to_numpy().astype(np.int64), piece


def _phrases(vocabulary: pa.Array, ids: np.ndarray, starts: np.ndarray, n: int) -> pa.Array:
    """The n words from each place on, joined by one space."""
    parts = [vocabulary.take(pa.array(ids[starts + k])) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_utf8()))


def _emit(names: pa.Array, lang: np.ndarray, phrases: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(lang)).cast(pa.string()), phrases.cast(pa.string()), pa.array(np.full(len(counts), n, np.int32)), pa.array(counts.astype(np.int64))],
        ["lang", "phrase", "size", "n"])


COUNTS = "lang string, phrase string, size int, n long"


def _word_counts(at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _batches_of_text(batches, at_once):
            names, vocabulary, lang, ids, _ = _numbered(langs, texts)
            key, n = np.unique(lang * max(1, len(vocabulary)) + ids, return_counts=True)
            of, word = np.divmod(key, max(1, len(vocabulary)))
            yield _emit(names, of, vocabulary.take(pa.array(word)), 1, n)
    return run


def _text_bits(texts: pa.Array) -> np.ndarray:
    """A number for every text. Only ever used to leave out what is certainly rare."""
    raw, offsets = text_bytes(texts)
    return slice_hashes(raw, offsets[:-1], offsets[1:])


def _pair_bits(lang: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """The filter bit of a word, or of a pair of words, of a language."""
    h = spread(lang * np.uint64(31) + first)
    if second is not None:
        h = spread(h * np.uint64(37) + second)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """One bit per frequent word or pair (lang, phrase), built by Spark's bitmap aggregate; of fixed size."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch.column(1), " ")
            first, second = pc.list_element(parts, 0), None
            if batch.num_rows and len(parts[0]) > 1:
                second = _text_bits(pc.list_element(parts, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_pair_bits(_text_bits(batch.column(0)), _text_bits(first), second))], ["bit"])

    bit = F.col("bit") + 1
    parts = frequent.select("lang", "phrase").mapInArrow(bits, "bit long").groupBy(F.bitmap_bucket_number(bit).alias("part")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in parts:
        found = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["part"] - 1) * len(found):r["part"] * len(found)] = found
    return out


def _long_counts(wanted, low: int, high: int, words_only: bool, at_once: int):
    """Counts phrases of ``low`` to ``high`` words whose words (or word pairs) all pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for langs, texts in _batches_of_text(batches, at_once):
            names, vocabulary, lang, ids, piece = _numbered(langs, texts)
            of_word, of_lang = _text_bits(vocabulary), _text_bits(names)
            m = len(ids) - 1
            if m < 1:
                continue
            joined = (piece[:-1] == piece[1:])
            if words_only:
                bit = _pair_bits(of_lang[lang], of_word[ids])
                passes = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                joined &= passes[:-1] & passes[1:]
            else:
                at = np.flatnonzero(joined)
                bit = _pair_bits(of_lang[lang[at]], of_word[ids[at]], of_word[ids[at + 1]])
                joined[at] = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            # number: equal for equal phrases of the length at hand, language included
            number, number_of = lang * len(vocabulary) + ids, np.arange(len(ids))
            whole = np.ones(len(ids), bool)
            for n in range(2, high + 1):
                whole = whole[:len(ids) - n + 1] & joined[n - 2:]
                if len(whole) == 0:
                    break
                at = np.flatnonzero(whole)
                longer, first, where, count = np.unique(number[at] * len(vocabulary) + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                number = np.zeros(len(whole), np.int64)
                number[at] = where
                if n >= low:
                    places = at[first]
                    yield _emit(names, lang[places], _phrases(vocabulary, ids, places, n), n, count)
    return run


def phrase_counts(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(frequent phrases: lang, words, f; totals: lang, n) of (lang, text) rows. Every phrase with ``least`` occurrences is there."""
    spark = texts.sparkSession

    def summed(counts: DataFrame, label: str) -> DataFrame:
        return staged(counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), label)

    words = staged(texts.mapInArrow(_word_counts(at_once), COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.filter(F.col("f") >= least)]
    for low, high in ((2, 2), (3, longest)):
        if low <= longest:
            wanted = spark.sparkContext.broadcast(frequent_filter(levels[-1]))
            levels.append(summed(texts.mapInArrow(_long_counts(wanted, low, high, low == 2, at_once), COUNTS), f"phrase-{high}"))
    stream = levels[0]
    for level in levels[1:]:
        stream = stream.union(level)
    return stream.select("lang", F.split("phrase", " ", -1).alias("words"), "f"), totals


STREAM = "lang string, words array<string>, f long, part int, outside boolean"


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted phrases with the open beginnings at hand. Of every phrase: the counts of its beginnings, and the
    greatest count of a phrase that is one word longer. A beginning from outside the part gives its greatest count only."""
    open_: list[list] = []  # [words, count, greatest count of a continuation, counts of its beginnings, outside, lang]
    out: list[tuple] = []

    def close(upto: int) -> None:
        while len(open_) > upto:
            words, f, ext, heads, outside, lang = open_.pop()
            out.append((lang, words, None if outside else f, None if outside else heads, ext))

    def flush() -> pa.RecordBatch:
        rows = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, TYPES)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, ["lang", "words", "f", "counts", "ext"])

    part = None
    for batch in batches:
        for lang, words, f, at, outside in zip(*[c.to_pylist() for c in batch.columns]):
            if at != part:
                close(0)
                part = at
            same = 0
            while same < len(open_) and len(open_[same][0]) < len(words) and open_[same][5] == lang and words[:len(open_[same][0])] == open_[same][0]:
                same += 1
            close(same)
            if open_ and len(open_[-1][0]) == len(words) - 1:
                open_[-1][2] = max(open_[-1][2], 0 if outside else f)
            open_.append([words, f, 0, [h[1] for h in open_], outside, lang])
        if len(out) > 10_000:
            yield flush()
    close(0)
    yield flush()


TYPES = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
PASSED = "lang string, words array<string>, f long, counts array<long>, ext long"


def _passed(stream: DataFrame, label: str) -> DataFrame:
    """The lockstep pass over a whole stream in the order of (lang, words): (lang, words, f, counts, ext).

    The order is cut into ranges. A range starts with the beginnings of its first phrase, which lie in earlier ranges: a few
    rows each, found by one small join. What a beginning learns in several ranges is put together at the end.
    """
    ranges = staged(stream.repartitionByRange("lang", "words").withColumn("part", F.spark_partition_id()), label)
    first = ranges.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("first")).select("part", "first.*")
    heads = first.filter(F.size("words") > 1).select(
        "part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.slice("words", 1, k))).alias("words"))
    outside = heads.join(stream, ["lang", "words"]).select("lang", "words", "f", "part", F.lit(True).alias("outside"))
    rows = ranges.select("lang", "words", "f", "part", F.lit(False).alias("outside")).union(outside)
    passed = rows.repartition("part").sortWithinPartitions("part", "lang", "words").mapInArrow(_lockstep, PASSED)
    return passed.groupBy("lang", "words").agg(F.max("f").alias("f"), F.max("counts").alias("counts"), F.max("ext").alias("ext"))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest-scoring cut of every phrase, in whole numbers of any length."""
    for batch in batches:
        best = []
        for a, lefts, rights, n in zip(*[c.to_pylist() for c in batch.columns[2:]]):
            cuts = [(1000 * a * n // (lo * r), k, lo, r) for k, (lo, r) in enumerate(zip(lefts, reversed(rights)), 1)]
            best.append(min(cuts)[0::2] + (min(cuts)[3],))
        score, left, right = zip(*best) if best else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.binary_join(batch.column(1), " "), batch.column(2), *[pa.array(list(c), pa.int64()) for c in (left, right)], batch.column(5),
             pa.array(list(score), pa.int64())], ["lang", "phrase", "a", "l", "r", "n", "score"])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 at_once: int = AT_ONCE) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    a, l and r count a phrase and both sides of its lowest-scoring cut, n all words of the language. Null and empty texts
    have no words; a null language counts as ``und``, together with rows that say so. Rows are counted as often as they
    occur. An empty table, or one without a frequent phrase, gives an empty result. Scores beyond 64 bits are an error.
    Whole texts are read three times: for words, pairs and longer phrases; only sums per task leave it.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    stream, totals = phrase_counts(texts, longest, least, at_once)
    stream = staged(stream, "phrase-stream")
    prefixes = _passed(stream, "phrase-prefixes")
    suffixes = _passed(stream.withColumn("words", F.reverse("words")), "phrase-suffixes")
    endings = suffixes.select("lang", F.reverse("words").alias("words"), F.col("counts").alias("rights"), F.col("ext").alias("before"))
    merged = prefixes.filter(F.size("words") > 1).hint("merge").join(endings, ["lang", "words"])
    kept = merged.filter(100 * F.greatest("ext", "before") < 100 * F.col("f")).join(totals, "lang")
    scored = kept.select("lang", "words", "f", "counts", "rights", "n").mapInArrow(
        _scores, "lang string, phrase string, a long, l long, r long, n long, score long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
