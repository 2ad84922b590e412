"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of template tokens are
hash-joined, and the fillers of a match must map one to one, so re-parameterised questions count and chance matches do not.
Windows of too few ordinary words, and items shorter than a window, are joined on their very words instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, U, mix, row_slices, signed, slice_hashes, text_bytes, word_hashes

WINDOWS = (8, 5)  # template tokens; items with fewer than 8 are looked up by 5
MIN_LITERALS = 3  # words in a window that are no placeholders; with fewer, only the very same words count
SHARE = 0.5  # of an item's tokens that have to be found
ENOUGH = 20  # tokens found that count whatever the item's length
CONSISTENT = 0.7  # of the fillers' pairs that a one-to-one mapping has to keep
FILTER_BITS = 26  # the broadcast filter has 2 ** 26 bits, 8 MB, however large the benchmark is

# fixed values: words that count as a unit behind a number
UNITS = ("km", "m", "cm", "mm", "miles", "mile", "feet", "ft", "inches", "inch", "kg", "g", "mg", "lb", "lbs", "pounds", "pound", "tons",
         "s", "sec", "seconds", "second", "minutes", "minute", "min", "hours", "hour", "h", "days", "day", "weeks", "week", "months",
         "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees", "liters", "litres", "l", "ml")

# fixed values: words that stand for a number, and words that open a sentence without being part of a name behind them
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
                "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty",
                "ninety", "hundred", "thousand", "million", "billion", "half", "quarter", "dozen", "twice")
OPENERS = ("a", "an", "the", "this", "that", "these", "those", "in", "on", "at", "by", "for", "from", "to", "with", "after", "before", "when", "while",
           "if", "as", "since", "until", "how", "what", "which", "who", "whose", "where", "why", "is", "are", "was", "were", "do", "does", "did", "can",
           "could", "will", "would", "should", "and", "but", "or", "so", "then", "now", "there", "here", "it", "its", "his", "her", "their", "our", "my",
           "your", "every", "each", "both", "all", "let", "suppose", "given", "find", "because", "although", "once", "today", "yesterday")

_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:\n"]] = True
_RNG = np.random.default_rng(404)
_EXACT = U(1 << 32)  # sets the hashes of exact windows apart from those of templates
_STEP = _RNG.integers(1, 1 << 62, max(WINDOWS), dtype=np.uint64) * U(2) + U(1)
_NUMBER, _UNIT, _NAME = (U(int(x)) for x in _RNG.integers(1, 1 << 62, 3))
_CAPITAL = np.array([c.isupper() or c.istitle() for c in map(chr, range(0x20000))])  # no letter beyond has case
_SLOT = U(3)  # low bits of a filler; an opener that is taken as a name has the lowest bit 0
_AT_ONCE = 1 << 20  # windows, with their variants


def _listed(words: tuple[str, ...]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(word_hashes(raw, np.array([0, len(raw)]), True)[0])


_UNIT_HASHES, _NUMBER_HASHES, _OPENER_HASHES = _listed(UNITS), _listed(NUMBER_WORDS), _listed(OPENERS)


def _among(words: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, words), len(listed) - 1)] == words


def _capital(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a capital letter of any script starts there, the place behind that character)."""
    b = [np.where(at + k < len(buf), buf[np.minimum(at + k, len(buf) - 1)], 0).astype(np.int64) for k in range(4)]
    size = 1 + (b[0] >= 0xC0) + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    tail = [x & 63 for x in b]
    code = np.choose(size - 1, [b[0], (b[0] & 31) << 6 | tail[1], (b[0] & 15) << 12 | tail[1] << 6 | tail[2],
                                (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]])
    return (code < len(_CAPITAL)) & _CAPITAL[np.minimum(code, len(_CAPITAL) - 1)], at + size


@dataclass
class Template:
    """Words of some rows, and the template tokens they make. Both have the rows' bounds."""
    words: np.ndarray  # hashes
    plain: np.ndarray  # of a word: no placeholder, and no opener of a sentence
    slot: np.ndarray  # of a word: a placeholder, or part of one
    word_bounds: np.ndarray
    tokens: np.ndarray
    fillers: np.ndarray  # hash of what a placeholder stands for, 0 at ordinary words
    opener: np.ndarray
    bounds: np.ndarray


def _numbers_apart(buf: np.ndarray, offsets: np.ndarray, words: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Words such as 120km as a number and a unit: (hash, start, end)."""
    digit = (buf >= 48) & (buf <= 57)
    both = np.flatnonzero(digit[s] & ~digit[e - 1])
    if not len(both):
        return words, s, e
    cut = e[both] - 1
    loose = np.arange(len(both))
    while len(loose):  # the tail without a digit; its units are short
        loose = loose[~digit[cut[loose] - 1] & (e[both[loose]] - cut[loose] <= 8)]
        cut[loose] -= 1
    tail = slice_hashes(LOWER[buf], cut, e[both])
    unit = _among(tail, _UNIT_HASHES) & digit[cut - 1]
    both, cut, tail = both[unit], cut[unit], tail[unit]
    words = words.copy()
    words[both] = slice_hashes(LOWER[buf], s[both], cut)
    ends = e.copy()
    ends[both] = cut
    return np.insert(words, both + 1, tail), np.insert(s, both + 1, cut), np.insert(ends, both + 1, e[both])


def _spelled(buf: np.ndarray, words: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether a word is a number word, or two of them with a hyphen between."""
    out = _among(words, _NUMBER_HASHES)
    hyphen = np.flatnonzero(buf == 45)
    of = np.searchsorted(s, hyphen, "right") - 1
    inside = (of >= 0) & (hyphen + 1 < e[of]) & (hyphen > s[of])
    hyphen, of = hyphen[inside], of[inside]
    if len(of):
        low = LOWER[buf]
        out[of] |= _among(slice_hashes(low, s[of], hyphen), _NUMBER_HASHES) & _among(slice_hashes(low, hyphen + 1, e[of]), _NUMBER_HASHES)
    return out


def template(buf: np.ndarray, offsets: np.ndarray) -> Template:
    """Tokens are words without outer punctuation, case folded; 120km is two of them.

    Number: starts with a digit or is one as a character (a half) or word; number words in a row are one token. Unit: one of
    UNITS behind a number. Name: a capital, then no capital, not at the start of a sentence or line; names in a row are one
    token, together with a word ahead of them that opens the sentence, unless that is one of OPENERS. Any other capitalised
    word that opens a sentence may be a name or not: it stays an ordinary word and is marked as an opener.
    """
    words, s, e, _ = word_hashes(buf, offsets, True, _CORE)
    words, s, e = _numbers_apart(buf, offsets, words, s, e) if len(words) else (words, s, e)
    bounds = np.searchsorted(s, offsets)
    if not len(words):
        none = np.zeros(0, bool)
        return Template(words, none, none, bounds, words, words, none, bounds)
    first, second_byte = buf[s], buf[np.minimum(s + 1, len(buf) - 1)]
    spelled = _spelled(buf, words, s, e)
    fraction = (first == 0xC2) & (second_byte >= 0xBC) & (second_byte <= 0xBE) | (first == 0xE2) & (second_byte == 0x85)
    number = (first >= 48) & (first <= 57) | spelled | fraction
    unit = np.append(False, number[:-1]) & _among(words, _UNIT_HASHES)
    line = np.zeros(len(s), bool)  # first word of a row
    line[bounds[:-1][bounds[:-1] < len(s)]] = True
    fresh = line | np.append(True, _END[buf[np.minimum(e[:-1], len(buf) - 1)]] | (buf[s[1:] - 1] == 10))
    capital, second = _capital(buf, s)
    capital &= ~((second < e) & _capital(buf, second)[0]) & ~unit & ~number
    name, opener = capital & ~fresh, capital & fresh
    slot = number | unit | name
    # a placeholder goes on in the next word
    close = np.append(False, s[1:] == e[:-1] + 1) & ~fresh  # nothing but one character between, so no comma and a blank
    leading = opener & np.append((name & close)[1:], False) & ~_among(words, _OPENER_HASHES)
    goes_on = close & (name & np.append(False, (name | leading)[:-1]) | spelled & np.append(False, spelled[:-1]))
    starts = np.flatnonzero(~goes_on)
    size = np.diff(np.append(starts, len(words)))
    place = np.arange(len(words)) - np.repeat(starts, size)
    joined = np.add.reduceat(mix(words + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), starts)
    filler = np.where(size > 1, joined, words[starts]) | _SLOT
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name | leading, _NAME, words)))[starts]
    held = (slot | leading)[starts]
    return Template(words, ~slot & ~opener, slot, bounds, kind, np.where(held, filler, U(0)), (opener & ~leading)[starts], np.searchsorted(s[starts], offsets))


def template_windows(tokens: np.ndarray, fillers: np.ndarray, opener: np.ndarray, bounds: np.ndarray, width: int) \
        -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window hash, token place, openers taken as names) of every window within a row that has enough ordinary words.

    The openers of a window are names or ordinary words in every combination, as the other side may have them elsewhere in a
    sentence. Windows come in parts of bounded size.
    """
    n = len(tokens) - width + 1
    if n <= 0:
        return
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    plain, opens = (np.concatenate([[0], np.cumsum(x)]) for x in (fillers == 0, opener))
    plain, opens = plain[width:] - plain[:n], opens[width:] - opens[:n]
    whole = np.flatnonzero((np.arange(n) + width <= bounds[row + 1]) & (plain >= MIN_LITERALS))
    part = np.cumsum(1 << opens[whole]) // _AT_ONCE
    for at in np.split(whole, np.flatnonzero(part[1:] != part[:-1]) + 1):
        rolled, left, taken = np.full(len(at), U(width), np.uint64), plain[at], np.zeros(len(at), np.int64)
        for k in range(width):
            rolled += tokens[at + k] * _STEP[k]
        for k in range(width):
            more = np.flatnonzero(opener[at + k] & (left > MIN_LITERALS))
            if len(more):
                rolled = np.append(rolled, rolled[more] + (_NAME - tokens[at[more] + k]) * _STEP[k])
                left, taken, at = np.append(left, left[more] - 1), np.append(taken, taken[more] | 1 << k), np.append(at, at[more])
        yield mix(rolled), at, taken


def exact_windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, token place, 0) of every window within a row, by its very words."""
    n = max(0, len(words) - width + 1)
    at = np.flatnonzero(np.arange(n) + width <= bounds[np.searchsorted(bounds, np.arange(n), "right")])
    rolled = np.full(len(at), U(width) + _EXACT, np.uint64)
    for k in range(width):
        rolled += words[at + k] * _STEP[k]
    return mix(rolled), at, np.zeros(len(at), np.int64)


def _rows(wanted: np.ndarray | None, exact_widths: Iterable[int] = ()):
    """Windows of a batch of (id, text). With a filter: those that it lets through, exact ones of the given widths. Without: of a
    benchmark, with its size, exact ones where a template could have too few ordinary words and for items under the least width.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets):
                t = template(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                plain = np.concatenate([[0], np.cumsum(t.plain)])
                widths = exact_widths if wanted is not None else (*WINDOWS, *range(1, min(WINDOWS)))
                parts = chain(((width, False, part) for width in WINDOWS for part in template_windows(t.tokens, t.fillers, t.opener, t.bounds, width)),
                              ((width, True, exact_windows(t.words, t.word_bounds, width)) for width in widths))
                for width, exact, (h, at, taken) in parts:
                    bounds = t.word_bounds if exact else t.bounds
                    sizes = np.diff(bounds)
                    row = np.searchsorted(bounds, at, "right") - 1
                    if wanted is not None:
                        bit = (h & U((1 << FILTER_BITS) - 1)).astype(np.int64)
                        ok = (wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                    else:  # a benchmark item goes by its widest window
                        ok = width == np.where(sizes[row] >= WINDOWS[0], WINDOWS[0], np.minimum(sizes[row], WINDOWS[1]))
                        if exact and width >= min(WINDOWS):
                            ok &= plain[at + width] - plain[at] < MIN_LITERALS
                    h, at, row, taken = h[ok], at[ok], row[ok], taken[ok]
                    spread = at[:, None] + np.arange(width)
                    if exact and wanted is not None:  # what is a name there may be written small here
                        slots = t.words[spread] | _SLOT
                    elif exact:
                        slots = np.where(t.slot[spread], t.words[spread] | _SLOT, U(0))
                    else:
                        named = (taken[:, None] >> np.arange(width)) & 1 > 0
                        slots = np.where(named, (t.tokens[spread] | _SLOT) ^ U(1), t.fillers[spread])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), signed(slots.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + i)), pa.array((at - bounds[row]).astype(np.int64)), signed(h),
                         pa.array(np.full(len(at), width, np.int64)), pa.array(sizes[row].astype(np.int64)), pa.array(np.full(len(at), exact)), lists],
                        ["id", "place", "hash", "width", "size", "exact", "fillers"])
    return windows


ROWS = "id long, place long, hash long, width long, size long, exact boolean, fillers array<long>"


def window_filter(bench: DataFrame) -> np.ndarray:
    """One bit per hash value of the benchmark's windows, built by Spark's bitmap aggregate."""
    bit = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    parts = bench.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in parts:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["part"] - 1) * len(bits):r["part"] * len(bits)] = bits
    return out


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(key, item, item_tokens, found, n_fillers, n_changed) for every document that holds a benchmark item.

    Windows of a document that match an item at one offset belong together; they count if their fillers map one to one but
    for a rest. An item is held if half of its tokens, or 20, are found. Items under five tokens are held where all their tokens
    stand in a row, a single word wherever it stands. Null texts hold nothing; items without a letter or digit are in none. Rows that share a key, also a null one, are one document; items
    likewise. Empty tables give an empty result. Windows outside the benchmark are dropped where they are made, by a filter
    of fixed size; what is left is joined, and no group is larger than one document's matches with one item.
    """
    items = bench.select(F.col(item).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).mapInArrow(_rows(None), ROWS)
    wanted = docs.sparkSession.sparkContext.broadcast(window_filter(items))
    exact_widths = sorted(r["width"] for r in items.filter("exact").select("width").distinct().collect())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(wanted.value, exact_widths)(batches)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(found, ROWS)
    x, y = rows.alias("x"), items.alias("y")
    hits = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.width") == F.col("y.width"))).select(
        F.col("x.id").alias("doc"), F.col("y.id").alias("item"), F.col("y.size").alias("size"), F.col("x.width").alias("width"),
        F.col("y.place").alias("place"), (F.col("x.place") - F.col("y.place")).alias("offset"),
        F.filter(F.arrays_zip(F.col("y.fillers").alias("b"), F.col("x.fillers").alias("d")), lambda z: z["b"] != 0).alias("pairs"))
    # where both have the same opener, the window also meets with that as an ordinary word, and so it should count
    hits = hits.filter(~F.exists("pairs", lambda z: (z["b"] == z["d"]) & (z["b"].bitwiseAND(3) == 2))).withColumn(
        "pairs", F.transform("pairs", lambda z: F.struct(z["b"].bitwiseOR(F.lit(3)).alias("b"), z["d"].bitwiseOR(F.lit(3)).alias("d"))))
    runs = hits.groupBy("doc", "item", "offset", "width", "size").agg(
        F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    n_from = F.size(F.array_distinct(F.transform("pairs", lambda z: z["b"])))
    n_to = F.size(F.array_distinct(F.transform("pairs", lambda z: z["d"])))
    kept = runs.filter(F.least(n_from, n_to) >= CONSISTENT * F.size("pairs"))
    per = kept.groupBy("doc", "item", "width", "size").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("p"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    covered = F.aggregate(F.transform("p", lambda a, i: F.least(F.col("width"), F.coalesce(F.get("p", i + 1) - a, F.col("width")))),
                          F.lit(0).cast("long"), lambda s, v: s + v)
    out = per.select("doc", "item", "size", covered.alias("found"), F.size("pairs").cast("long").alias("n_fillers"),
                     F.size(F.filter("pairs", lambda z: z["b"] != z["d"])).cast("long").alias("n_changed"))
    out = out.groupBy("doc", "item").agg(F.max_by("size", "found").alias("item_tokens"), F.max("found").alias("found"),
                                         F.max("n_fillers").alias("n_fillers"), F.max("n_changed").alias("n_changed"))
    return out.filter((F.col("found") >= SHARE * F.col("item_tokens")) | (F.col("found") >= ENOUGH)) \
        .select(F.col("doc").alias(key), F.col("item").alias(item), "item_tokens", "found", "n_fillers", "n_changed")


def without_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, all columns kept."""
    hit = contaminated(docs, bench, key, **columns).select(F.col(key).alias("__hit")).distinct()
    return docs.join(hit, docs[key].cast("long").eqNullSafe(F.col("__hit")), "left_anti")
