"""Removes every byte covered by a string of ``length`` bytes that also starts elsewhere, by suffix sorting in blocks.

All starting places are dealt out by content first: the window of ``length`` bytes at a place belongs to the leftmost of its
least-hashing k-grams (its anchor), so equal windows always meet under one anchor. Windows of one anchor form a segment.
Segments that occur once under an anchor of their own need no sorting, equal segments are counted, and only different
segments under one anchor are suffix-sorted, packed into blocks of bounded size.

The sort works in two stages. Suffixes smaller than their successors are sorted directly; all others follow by scanning the
buckets of first bytes from the least to the greatest. Adjacent common prefixes then show which windows repeat.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept_by_worker, staged
from .textbytes import BYTE_CODE, U, mix, powers, row_slices, signed, text_bytes

LENGTH = 400  # bytes of a repeated string
GRAM = 24  # bytes of an anchor
STRETCH = 1 << 19  # bytes whose anchors are found at once
TOGETHER = 1 << 15  # bytes of short rows that go through it side by side
BLOCK = 1 << 20  # bytes that are suffix-sorted at once
MAX_GROUP = 1 << 22  # bytes under one anchor from which on a group is split
AT_FIRST = 2  # words of eight bytes by which two suffixes are compared on their own
MARK = 255  # never part of UTF-8; stands behind every segment

SEGMENTS = "row long, at long, n long, anchor long, content1 long, content2 long"


def _prefix_sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = powers(len(s) + 1)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(BYTE_CODE[s] * base[:len(s)], out=sums[1:])
    return sums, inverse


P61 = U((1 << 61) - 1)
_RNG = np.random.default_rng(61)
_CODE61 = _RNG.integers(1, 1 << 60, 256, dtype=np.uint64)
_BASE61 = int(_RNG.integers(1 << 59, 1 << 60))


def _times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2 ** 61 - 1."""
    ah, al, bh, bl = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    mid = al * bh + ah * bl
    out = (ah * bh << U(1)) + (mid >> U(30)) + ((mid & U(0x3FFFFFFF)) << U(31)) + al * bl
    return _rest61(out)


def _rest61(x: np.ndarray) -> np.ndarray:
    x = (x & P61) + (x >> U(61))
    return np.where(x >= P61, x - P61, x)


def _table61(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and their inverses."""
    made = kept_by_worker("powers modulo 2 ** 61 - 1")
    if "power" not in made or len(made["power"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("power", _BASE61), ("inverse", pow(_BASE61, -1, int(P61)))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, _times61(out, np.full(1, pow(base, len(out), int(P61)), np.uint64))])
            made[name] = out
    return made["power"], made["inverse"]


class _Prefixes61:
    """Hashes of any slice of some bytes: polynomials modulo the prime 2 ** 61 - 1 at a random base, so two different slices
    agree with a probability below their length over 2 ** 61, whatever they hold."""

    def __init__(self, s: np.ndarray):
        power, self.inverse = _table61(len(s) + 1)
        terms = _times61(_CODE61[s], power[:len(s)])
        high, low = np.cumsum(terms >> U(31)), np.cumsum(terms & U(0x7FFFFFFF))
        sums = _rest61((high >> U(30)) + ((high & U(0x3FFFFFFF)) << U(31)) + _rest61(low))
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _times61(_rest61(self.sums[start + size] + P61 - self.sums[start]), self.inverse[start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from running minima of blocks of w in both directions."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchored_segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, content1, content2) of a text's segments: maximal runs of windows with one anchor place.

    Long texts go in stretches that overlap by less than a window; a segment cut there is just two segments.
    """
    parts = [_stretch_segments(raw[lo:min(len(raw), lo + STRETCH + length - 1)], None, lo, length, gram)
             for lo in range(0, max(0, len(raw) - length + 1), STRETCH)]
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _stretch_segments(part: np.ndarray, whole: np.ndarray | None, lo: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the windows of ``part``, or of those windows in it that ``whole`` flags; starts count from -lo."""
    w = length - gram + 1
    sums, inverse = _prefix_sums(part)
    n = len(part) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * inverse[:n])
    # 44 bits of the hash, then the place: the leftmost wins a tie
    least = _sliding_min((grams & ~U((1 << 20) - 1)) | np.arange(n, dtype=np.uint64), w)
    place = (least & U((1 << 20) - 1)).astype(np.int64)
    if whole is not None:
        place = np.where(whole, place, -1)
    start = np.flatnonzero(np.diff(place, prepend=-1))
    stop = np.append(start[1:], len(place))
    if whole is not None:
        start, stop = start[whole[start]], stop[whole[start]]
    content = (sums[stop + length - 1] - sums[start]) * inverse[start]
    size = (stop - start).astype(np.uint64)
    sound = _Prefixes61(part).of(start, stop - start + length - 1)
    return start + lo, stop - start, grams[place[start]], mix(content + size), sound


def segments_of_rows(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor, content1, content2) of all rows' segments. Short rows go side by side, without the windows
    that reach from one into the next."""
    parts = []
    for i, j in row_slices(offsets, TOGETHER):
        part, bounds = buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if j == i + 1:
            found = anchored_segments(part, length, gram)
            row = np.full(len(found[0]), i)
        elif len(part) >= length:
            ends = np.repeat(bounds[1:], np.diff(bounds))[:len(part) - length + 1]
            found = _stretch_segments(part, np.arange(length, len(part) + 1) <= ends, 0, length, gram)
            row = np.searchsorted(bounds, found[0], "right") - 1
            found = (found[0] - bounds[row], *found[1:])
            row += i
        else:
            continue
        parts.append((row, *found))
    if not parts:
        return (np.zeros(0, np.int64), *anchored_segments(buf[:0], length, gram))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SEGMENTS.split(", ")]
    for batch in batches:
        buf, offsets = text_bytes(batch.column(1))
        rows = batch.column(0)
        for i, j in row_slices(offsets, 1 << 21):
            row, start, n, anchor, c1, c2 = segments_of_rows(buf, offsets[i:j + 1])
            index = pa.array(row + i)
            yield pa.RecordBatch.from_arrays([rows.take(index), pa.array(start), pa.array(n), signed(anchor), signed(c1), signed(c2)], names)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starting places of all suffixes of ``s`` in order of their first ``depth`` bytes or more, by two-stage sorting.

    A suffix is small if it is less than its successor. Small suffixes are sorted directly by eight bytes at a time as far as
    ``depth``; equal ones up to there stay together. The others are induced: going through the buckets in order, the
    predecessor of each suffix, if it is not small, takes the next free place at the head of its own bucket.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    # type of each place: compare with the next byte; a run of equal bytes has the type of its end. The end counts as least.
    change = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    run_small = np.append(s[change[:-1]] < s[change[:-1] + 1], False)
    small = np.repeat(run_small, np.diff(change, prepend=-1))
    direct = _sorted_directly(s, _words(s), np.flatnonzero(small), depth)
    counts = np.bincount(s, minlength=256)
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])
    small_count = np.bincount(s[direct], minlength=256)
    out = np.full(n, -1, np.int64)
    at = 0
    for b in np.flatnonzero(small_count):
        end = head[b] + counts[b]
        out[end - small_count[b]:end] = direct[at:at + small_count[b]]
        at += small_count[b]
    free = head.copy()

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[~small[before]]
        first = s[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        number = np.bincount(first, minlength=256)
        rank = np.arange(len(first)) - np.repeat(np.cumsum(number) - number, number)
        out[free[first] + rank] = before
        free[:] += number

    induce(np.array([n]))  # the empty suffix comes before all others
    for b in np.flatnonzero(counts):
        done = head[b]
        while done < free[b]:  # suffixes that start with a run of this byte induce others of the same bucket
            stop = free[b]
            induce(out[done:stop])
            done = stop
        induce(out[head[b] + counts[b] - small_count[b]:head[b] + counts[b]])
    return out


def _words(s: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number, most significant first; zeros stand behind the end."""
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    return np.ndarray((len(s) + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)


_BYTES = np.array([1 << 8 * i for i in range(8)], np.uint64)  # least numbers of 1 to 8 significant bytes


def _next_difference(s: np.ndarray, at: np.ndarray, stop: np.ndarray, gap: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Bytes from ``at``, up to ``stop``, until s differs from itself ``gap`` places on. Pairs with one gap whose ranges overlap
    are compared as one range, eight bytes at a time, so a byte that many of them cover is read once; the first
    eight that differs then tells a pair which byte does."""
    words = _words(s) if words is None else words
    out, line = stop - at, gap * (len(s) + 1)
    order = np.argsort(line + at)
    at, gap, line = at[order], gap[order], line[order]
    upto = np.maximum.accumulate(line + stop[order]) - line
    fresh = np.append(True, (gap[1:] != gap[:-1]) | (at[1:] > upto[:-1]))
    more = np.cumsum(upto - np.where(fresh, at, np.append(0, upto[:-1])))
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(more // (8 * STRETCH))) + 1):
        head = np.flatnonzero(np.append(True, fresh[part[1:]]))
        begin = at[part[head]]
        size = (upto[part[np.append(head[1:], len(part)) - 1]] - begin + 7) >> 3
        flat = np.cumsum(size) - size
        place = np.arange(0, 8 * size.sum(), 8) + np.repeat(begin - 8 * flat, size)
        differ = words.take(place)
        place += np.repeat(gap[part[head]], size)
        differ ^= words.take(place)
        some = np.flatnonzero(differ != 0)
        eights, value = np.append(some, [len(differ)] * 2), np.append(differ[some], _BYTES[[-1, -1]])
        mine = at[part] + np.repeat(8 * flat - begin, np.diff(np.append(head, len(part))))
        nth = np.searchsorted(some, mine >> 3)
        ahead = np.where(eights[nth] > mine >> 3, ~U(0), ~U(0) >> (8 * (mine & 7)).astype(U))  # bytes from the pair's own on
        nth += (value[nth] & ahead) == 0
        ahead[eights[nth] > mine >> 3] = ~U(0)
        found = 8 * eights[nth] + 8 - np.searchsorted(_BYTES, value[nth] & ahead, "right") - mine
        out[order[part]] = np.minimum(out[order[part]], found)
    return out


def _common_prefix(s: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to ``depth``, that the suffixes at a and b > a share, ``known`` of which are known; all by their bytes. Eight at
    a time at first; pairs that share more are compared together with others at their distance."""
    most = np.minimum(depth, len(s) - b)
    shared = np.minimum(most, known)
    rest = np.arange(len(a))
    for _ in range(AT_FIRST):
        n = shared.take(rest)
        differ = words.take(a.take(rest) + n) ^ words.take(b.take(rest) + n)
        n += 8 - np.searchsorted(_BYTES, differ, "right")
        shared[rest] = n
        rest = rest[(differ == 0) & (n < most.take(rest))]
    shared = np.minimum(shared, most)
    at = a[rest] + shared[rest]
    if len(rest):
        shared[rest] += _next_difference(s, at, a[rest] + most[rest], b[rest] - a[rest], words)
    return shared


def _in_order(group: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (group, rank, place) in ascending order; as single numbers where 63 bits hold them."""
    if not len(group):
        return group, rank, place
    low, mid = int(place.max()).bit_length(), int(rank.max()).bit_length()
    if int(group.max()).bit_length() + mid + low > 63:
        by = np.lexsort((place, rank, group))
        return group[by], rank[by], place[by]
    packed = np.sort(group << mid + low | rank << low | place)
    return packed >> mid + low, packed >> low & (1 << mid) - 1, packed & (1 << low) - 1


def _sorted_directly(s: np.ndarray, words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by the ``depth`` bytes behind them; past the end of ``s`` counts as least.

    The first eight bytes are one key. Places that tie are compared with the first of their group: the length of the common
    prefix and the byte behind it put each before, beside or behind it, which splits the group further.
    """
    symbols = np.concatenate([s.astype(np.int16) + 1, np.zeros(depth + 8, np.int16)])
    key = words[places]
    by = np.argsort(key)
    order, key = places[by], key[by]
    fresh = np.append(True, key[1:] != key[:-1])
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rows = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    _, _, order[rows] = _in_order(group[rows], np.zeros(len(rows), np.int64), order[rows])
    known = np.full(len(rows), 8)  # bytes that a group shares
    while len(rows):
        g, rank = group[rows], np.full(len(rows), depth)
        others = np.flatnonzero(g != rows)  # all but the first of each group, which has the least place
        pivot, mine = order[g[others]], order[rows[others]]
        shared = _common_prefix(s, words, pivot, mine, known[others], depth)
        less = symbols[mine + shared] < symbols[pivot + shared]
        rank[others] = np.where(shared >= depth, depth, np.where(less, shared, 2 * depth - shared))
        g, rank, order[rows] = _in_order(g, rank, order[rows])
        fresh = np.append(True, (rank[1:] != rank[:-1]) | (g[1:] != g[:-1]))
        group[rows] = rows[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        open_ = ~(fresh & np.append(fresh[1:], True)) & (rank != depth)
        rows, known = rows[open_], np.minimum(rank, 2 * depth - rank)[open_]
    return order


def adjacent_prefixes(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether neighbours in ``order`` share their first ``depth`` bytes, by these bytes."""
    a, b = np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:])
    same, words = np.zeros(len(a), bool), _words(s)
    fits = np.flatnonzero(b + depth <= len(s))
    for at in (0, depth - 8) if depth >= 8 else ():  # most differ at one of the ends
        fits = fits[words.take(a[fits] + at) == words.take(b[fits] + at)]
    if len(fits):
        same[fits] = _next_difference(s, a[fits], a[fits] + depth, b[fits] - a[fits], words) == depth
    return same


def repeated_windows(texts: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """Per text, which of its windows of ``length`` bytes starts anywhere else in ``texts`` too."""
    s = np.concatenate([np.append(t, np.uint8(MARK)) for t in texts])
    order = suffix_array(s, length)
    same = adjacent_prefixes(s, order, length)
    repeated = np.zeros(len(s), bool)
    repeated[order[:-1][same]] = repeated[order[1:][same]] = True
    ends = np.cumsum([len(t) + 1 for t in texts])
    return [repeated[e - len(t) - 1:e - length] for t, e in zip(texts, ends)]


def _runs(flags: list[np.ndarray]) -> tuple[list[list[int]], list[list[int]]]:
    """Per array, where its runs of set flags begin and where they end."""
    none = np.zeros(1, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([none, *[x for f in flags for x in (f, none)]]).view(np.int8)))
    bounds = np.cumsum([0, *[len(f) + 1 for f in flags]])
    cuts = np.searchsorted(edge[::2], bounds)
    shift = np.repeat(bounds[:-1], np.diff(cuts))
    return tuple([x[i:j] for i, j in itertools.pairwise(cuts.tolist())] for x in ((edge[::2] - shift).tolist(), (edge[1::2] - shift).tolist()))


def _starts(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))


def _sorted_block(block: pd.DataFrame) -> pd.DataFrame:
    run_from, run_to = _runs(repeated_windows([np.frombuffer(x, np.uint8) for x in block["body"]]))
    return block[["anchor", "content1", "content2"]].assign(run_from=run_from, run_to=run_to)


def _sort_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (grp, anchor, content1, content2, body) sorted by grp -> runs of repeated windows of each; groups are packed into
    blocks of about BLOCK bytes, each whole."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        starts = _starts(held["grp"].to_numpy())
        sizes = np.add.reduceat(held["body"].str.len().to_numpy(), starts)
        block = (np.cumsum(sizes) - sizes) // BLOCK
        cuts = starts[_starts(block)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _sorted_block(held.iloc[a:b])
        held = held.iloc[cuts[-1]:].reset_index(drop=True)
    if held is not None:
        yield _sorted_block(held)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (anchor, content1, content2, body) -> one row per window with its two hashes, many bodies at once."""
    names = ["anchor", "content1", "content2"]
    for batch in batches:
        sizes = batch["body"].str.len().to_numpy(np.int64)
        for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(np.cumsum(sizes) // STRETCH)) + 1):
            s = np.frombuffer(b"".join(batch["body"].iloc[part]), np.uint8)
            sums, inverse = _prefix_sums(s)
            n = sizes[part] - LENGTH + 1
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = place + np.repeat(np.cumsum(sizes[part]) - sizes[part], n)
            value = (sums[at + LENGTH] - sums[at]) * inverse[at]
            yield pd.DataFrame({c: np.repeat(batch[c].to_numpy()[part], n) for c in names} | {
                "place": place, "w1": mix(value).view(np.int64), "w2": _Prefixes61(s).of(at, LENGTH).view(np.int64)})


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, wanted in zip(batch["text"], batch["wanted"]):
            raw = (text or "").encode()
            out += [(w["anchor"], w["content1"], w["content2"], raw[w["at"]:w["at"] + w["n"] + LENGTH - 1]) for w in wanted]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["anchor", "content1", "content2", "body"])
                out = []
        yield pd.DataFrame(out, columns=["anchor", "content1", "content2", "body"])


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``raw`` without the spans, and the number of maximal runs they make."""
    left, at, n_spans = [], 0, 0
    for a, b in sorted(spans):
        if a > at or not n_spans:  # ranges that touch are one run
            left.append(raw[at:a])
            n_spans += 1
        at = max(at, b)
    return b"".join([*left, raw[at:]]), n_spans


def _cut(with_text: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc"], batch["text"], batch["spans"]):
                raw = (text or "").encode()
                kept, n_spans = kept_bytes(raw, [] if spans is None else [(int(x["a"]), int(x["b"])) for x in spans])
                rows.append((doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "replace") if with_text else None))
            out = pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
            yield out.astype({"doc": "Int64"})
    return cut


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(row, a, b): byte ranges that repeat, from (row, text) with a ``row`` of its own for each text.

    Groups under one anchor beyond ``max_group`` bytes are split over blocks by content; windows of such a group are then
    compared across its blocks by counting their hashes, so a passage that a third of all documents share is no task's load.
    """
    segments = staged(docs.select("row", "text").mapInArrow(_segments, SEGMENTS), "suffix-segments")
    kinds = staged(segments.groupBy("anchor", "content1", "content2").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.min(F.struct("row", "at")).alias("first")), "suffix-kinds")
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + LENGTH).alias("bytes")).filter("kinds > 1")
    several = kinds.join(anchors, "anchor")
    wanted = several.select(F.col("first.row").alias("row"), F.struct("anchor", "content1", "content2", F.col("first.at").alias("at"), "n").alias("w")) \
        .groupBy("row").agg(F.collect_list("w").alias("wanted"))
    bodies = docs.select("row", "text").join(wanted, "row").select("text", "wanted").mapInPandas(
        _bodies, "anchor long, content1 long, content2 long, body binary")
    salt = F.when(F.col("bytes") > max_group, F.pmod(F.col("content1"), F.ceil(F.col("bytes") / max_group))).otherwise(F.lit(0))
    placed = bodies.join(anchors, "anchor").select("anchor", "content1", "content2", "body", F.col("bytes") > max_group,
                                                   F.xxhash64("anchor", salt).alias("grp")).toDF("anchor", "content1", "content2", "body", "crowded", "grp")
    placed = staged(placed, "suffix-bodies")
    runs = placed.select("grp", "anchor", "content1", "content2", "body").repartition("grp").sortWithinPartitions("grp", "content1", "content2") \
        .mapInPandas(_sort_blocks, "anchor long, content1 long, content2 long, run_from array<long>, run_to array<long>")
    runs = runs.select("anchor", "content1", "content2", F.explode(F.arrays_zip("run_from", "run_to")).alias("r")) \
        .select("anchor", "content1", "content2", F.col("r.run_from").alias("p"), F.col("r.run_to").alias("q"))
    # bodies of one anchor come from one task of a join; here they go over all tasks
    windows = staged(placed.filter("crowded").select("anchor", "content1", "content2", "body").repartition("content1", "content2").mapInPandas(
        _windows, "anchor long, content1 long, content2 long, place long, w1 long, w2 long"), "suffix-windows")
    often = windows.groupBy("anchor", "w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", "w1", "w2")
    across = windows.join(often, ["anchor", "w1", "w2"]).select("anchor", "content1", "content2", F.col("place").alias("p"), (F.col("place") + 1).alias("q"))
    within = several.filter("copies = 1").select("anchor", "content1", "content2").join(runs.union(across), ["anchor", "content1", "content2"])
    copied = kinds.filter("copies > 1").select("anchor", "content1", "content2", F.lit(0).cast("long").alias("p"), F.col("n").alias("q"))
    marked = staged(within.select("anchor", "content1", "content2", "p", "q").union(copied), "suffix-runs")
    spans = segments.join(marked, ["anchor", "content1", "content2"])
    return spans.select("row", (F.col("at") + F.col("p")).alias("a"), (F.col("at") + F.col("q") - 1 + LENGTH).alias("b"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept_text (broken characters
    replaced; null without ``with_text``).

    Null texts are empty; texts shorter than the length keep everything. Repeated rows are copies of each other, also under
    one key or a null one, so all of their long strings go. An empty table gives an empty result.
    """
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    same = Window.partitionBy("doc", F.xxhash64("text")).orderBy(F.lit(1))
    # rows that share a key are told apart by their text and number, so every row has its own place
    if base.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 OR doc IS NULL").isEmpty():
        rows = base.select("doc", F.col("doc").alias("row"), "text")
    else:
        rows = staged(base.withColumn("nth", F.row_number().over(same))
                      .select("doc", F.xxhash64("doc", "text", "nth").alias("row"), "text"), "suffix-rows")
    spans = repeated_spans(rows, max_group)
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = rows.join(per_row, "row", "left").select("doc", "text", "spans")
    out = joined.mapInPandas(_cut(with_text), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("doc", key)
