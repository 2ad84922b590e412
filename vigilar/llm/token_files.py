"""Token ids in files of an adaptive context-mixing range coder.

A file is a run of chunks; a chunk holds up to CHUNK ids in blocks that are coded independently, each with its length and
checksum, and every block starts with fresh models. Each id is predicted by order 2 (the id last seen behind the last two),
by order 1 (the id last seen behind the last one) and by order 0 (the chunk's id frequencies). Probabilities that adapt by
how sure the two predictions have been mix the three into one interval of a range coder. All blocks of a chunk advance
together, one id each per step, as numpy vectors.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back_memory, kept_by_worker, new_folder, staged
from .textbytes import text_bytes

MAGIC = b"VGTOK1\0\0"
TOKENIZER = "byte_bpe_50k.json"  # of public_tokenizers; a path of its own goes as it is
END_ID = 2
CHUNK = 1 << 22  # ids
BLOCKS = 4096  # of a full chunk
MIN_BLOCK = 512  # ids; smaller chunks have fewer blocks
ENCODE_BYTES = 1 << 21  # text bytes whose pieces are told apart at once
PIECES_AT_ONCE = 1 << 14  # handed to the tokenizer together; its results take far more room than ids
JOINED_BYTES = 1 << 10  # of pieces that go through the tokenizer as one string
KNOWN_PIECES = 500_000  # whose ids a Python worker remembers from slice to slice; beyond that it keeps the more frequent half
K1, K2 = 10, 11  # bits of the tables of order 1 and 2, for each block
MIX_BITS, ZERO_BITS = 11, 17
TOTAL_BITS = MIX_BITS + ZERO_BITS
U = np.uint64


class _Model:
    """Predictions and mixing weights of ``n`` blocks side by side."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.lane1, self.lane2, self.lane0 = lane << K1, lane << K2, lane << 4
        self.one, self.two = np.zeros(n << K1, np.int32), np.zeros(n << K2, np.int32)  # id * 4 + how sure
        self.hits = np.full(n * 16, 1024 << 12 | 1024, np.int32)  # how often order 2, order 1 were right, of 4096
        self.last, self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)

    def predict(self, n: int) -> None:
        """For the first ``n`` blocks: both predicted ids and the mix, f2 + f1 + f0 = 2 ** MIX_BITS, none of them 0."""
        spread = self.last[:n] * np.uint32(0x9E3779B1)
        self.at1 = (spread >> np.uint32(32 - K1)) + self.lane1[:n]
        self.at2 = ((spread + self.before[:n] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - K2)) + self.lane2[:n]
        self.v1, self.v2 = self.one.take(self.at1), self.two.take(self.at2)
        self.p1, self.p2 = self.v1 >> 2, self.v2 >> 2
        self.ctx = ((self.v2 & 3) << 2 | self.v1 & 3) + self.lane0[:n]
        hits = self.hits.take(self.ctx)
        self.a2, self.a1 = hits >> 12, hits & 4095
        self.f2 = (self.a2 * 2045 >> 12) + 1
        self.f1 = (self.a1 * (2046 - self.f2) >> 12) + 1
        self.f0 = (1 << MIX_BITS) - self.f2 - self.f1

    def update(self, ids: np.ndarray, is2: np.ndarray, hit1: np.ndarray) -> None:
        n, full = len(ids), np.int32(4095)
        a2 = self.a2 + ((is2 * full - self.a2) >> 5)
        a1 = np.where(is2, self.a1, self.a1 + ((hit1 * full - self.a1) >> 5))
        self.hits[self.ctx] = a2 << 12 | a1
        new = ids << 2  # the latest id is predicted next, the surer the more often it came in a row
        self.one[self.at1] = new + hit1 * np.minimum((self.v1 & 3) + 1, 3)
        self.two[self.at2] = new + is2 * np.minimum((self.v2 & 3) + 1, 3)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def _zero_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, frequencies that add up to 2 ** ZERO_BITS, none of them 0)."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << ZERO_BITS - 1:
        raise ValueError("a chunk has too many distinct ids")
    total = 1 << ZERO_BITS
    freq = 1 + counts * (total - len(symbols)) // counts.sum()
    freq[np.argmax(freq)] += total - freq.sum()
    return symbols, freq


def _block_sizes(n: int) -> np.ndarray:
    """Sizes of the blocks of n ids, the longer ones first, at most one apart."""
    k = max(1, min(BLOCKS, n // MIN_BLOCK))
    return np.full(k, n // k) + (np.arange(k) < n % k)


def _cut_back(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """An interval across a word's edge is cut back to the edge, so words never change later."""
    cross = (low ^ (low + span - U(1))) >= _TOP
    return np.where(cross, _TOP - (low & (_TOP - U(1))), span)


_TOP = U(1 << 32)


def encode_chunk(ids: np.ndarray) -> bytes:
    """One chunk: sizes, frequencies, then the blocks' words, each block with the checksum of its ids."""
    sizes = _block_sizes(len(ids))
    symbols, freq = _zero_order(ids)
    order0 = np.zeros(int(symbols[-1]) + 1, np.int64)
    order0[symbols] = (np.cumsum(freq) - freq) << 32 | freq
    begin = np.cumsum(sizes) - sizes
    k, steps, least = len(sizes), int(sizes[0]), int(sizes[-1])
    longer = int((sizes > least).sum())
    grid = ids[begin + np.arange(least)[:, None]].astype(np.int32)  # one row a step
    low, span = np.zeros(k, U), np.full(k, ~U(0))
    words, filled = np.zeros((k, steps + 4), np.uint32), np.zeros(k, np.int64)
    model = _Model(k)
    for t in range(steps):
        x = grid[t] if t < least else ids[begin[:longer] + t].astype(np.int32)
        n = len(x)
        model.predict(n)
        is2, hit1 = model.p2 == x, model.p1 == x
        f2, f1, f0 = model.f2, model.f1, model.f0
        z = order0.take(x)
        # the interval of an id: order 2 first, then order 1, then order 0 by its frequencies
        start = np.where(is2, 0, np.where(hit1, f2 << ZERO_BITS, (f2 + f1 << ZERO_BITS) + f0 * (z >> 32)))
        size = np.where(is2, f2 << ZERO_BITS, np.where(hit1, f1 << ZERO_BITS, f0 * (z & 0xFFFFFFFF)))
        lo, sp = low[:n], span[:n]
        r = sp >> U(TOTAL_BITS)
        lo += r * start.view(U)
        np.multiply(r, size.view(U), out=sp)
        short = np.flatnonzero(sp < _TOP)
        if len(short):
            a, b = lo[short], sp[short]
            words[short, filled[short]] = a >> U(32)
            filled[short] += 1
            lo[short], sp[short] = a << U(32), _cut_back(a, b) << U(32)
        model.update(x, is2, hit1)
    rows = np.arange(k)
    for shift in (32, 0):  # the rest of the interval
        words[rows, filled] = (low >> U(shift)) & (_TOP - U(1))
        filled += 1
    checks = [zlib.crc32(ids[b:b + s].astype("<u4").tobytes()) for b, s in zip(begin, sizes)]
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    head = struct.pack("<QIII", len(ids), k, len(symbols), len(table)) + table + np.array(checks, "<u4").tobytes() + filled.astype("<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(words[i, :filled[i]].astype("<u4").tobytes() for i in range(k))


def decode_chunk(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, place behind the chunk); raises where a checksum differs."""
    n_ids, k, n_symbols, n_table = struct.unpack_from("<QIII", raw, at)
    p = at + 20
    table = np.frombuffer(zlib.decompress(raw[p:p + n_table]), "<u4").astype(np.int64)
    symbols, freq = np.cumsum(table[:n_symbols]), table[n_symbols:]
    p += n_table
    checks = np.frombuffer(raw, "<u4", k, p)
    filled = np.frombuffer(raw, "<u4", k, p + 4 * k).astype(np.int64)
    p += 8 * k
    if struct.unpack_from("<I", raw, p)[0] != zlib.crc32(raw[at:p]):
        raise ValueError("the header of a chunk is damaged")
    stream = np.concatenate([np.frombuffer(raw, "<u4", int(filled.sum()), p + 4), np.zeros(2, np.uint32)]).astype(U)
    behind = p + 4 + 4 * int(filled.sum())
    slots = np.repeat(symbols << 40 | (np.cumsum(freq) - freq) << 20 | freq, freq)  # what stands at a place of order 0
    sizes = _block_sizes(n_ids)
    begin, steps, least = np.cumsum(sizes) - sizes, int(sizes[0]), int(sizes[-1])
    longer = int((sizes > least).sum())
    read = np.cumsum(filled) - filled
    low, span = np.zeros(k, U), np.full(k, ~U(0))
    code = (stream[read] << U(32)) | stream[read + 1]
    read = read + 2
    out, grid, model = np.zeros(n_ids, np.int64), np.zeros((least, k), np.int32), _Model(k)
    for t in range(steps):
        n = k if t < least else longer
        model.predict(n)
        f2, f1, f0 = model.f2, model.f1, model.f0
        lo, sp = low[:n], span[:n]
        r = sp >> U(TOTAL_BITS)
        slot = np.minimum((code[:n] - lo) // r, U((1 << TOTAL_BITS) - 1)).astype(np.int32)
        end2 = f2 << ZERO_BITS
        end1 = end2 + (f1 << ZERO_BITS)
        is2, known = slot < end2, slot < end1
        z = slots.take(np.where(known, 0, slot - end1) // f0)
        x = np.where(is2, model.p2, np.where(known, model.p1, z >> 40)).astype(np.int32)
        start = np.where(is2, 0, np.where(known, end2, end1 + f0 * (z >> 20 & 0xFFFFF)))
        size = np.where(is2, end2, np.where(known, f1 << ZERO_BITS, f0 * (z & 0xFFFFF)))
        if t < least:
            grid[t] = x
        else:
            out[begin[:longer] + t] = x
        lo += r * start.view(U)
        np.multiply(r, size.view(U), out=sp)
        short = np.flatnonzero(sp < _TOP)
        if len(short):
            a, b = lo[short], sp[short]
            lo[short], sp[short] = a << U(32), _cut_back(a, b) << U(32)
            code[short] = (code[short] << U(32)) | stream[np.minimum(read[short], len(stream) - 1)]
            read[short] += 1
        model.update(x, is2, model.p1 == x)
    out[begin + np.arange(least)[:, None]] = grid
    for i, (b, s) in enumerate(zip(begin, sizes)):
        if zlib.crc32(out[b:b + s].astype("<u4").tobytes()) != checks[i]:
            raise ValueError(f"block {i} is damaged")
    return out, behind


# ------------------------------------------------------------------ text to ids

_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_FILLED = _SOLID.copy()
_FILLED[0xC3:0xE0] = True  # first bytes of U+00C0 to U+07FF, where no character is a blank
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLOSES = _SOLID | (np.arange(256) >= 128)
_WORD_RANK = np.full(256, 2, np.int8)  # 0: ASCII letter, 1: byte of U+00C0 to U+027F, letters but for two signs
_WORD_RANK[_LETTER], _WORD_RANK[0x80:0xC0], _WORD_RANK[0xC3:0xCA] = 0, 1, 1
_SIGN = _SOLID & ~_LETTER
_SIGN[48:58] = _SIGN[39] = False  # an apostrophe may go on with letters
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
_AS_CHARACTERS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def cut_places(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces that texts are cut into: before a single space and on both sides of a single line end, between
    characters that are no blanks, and between an ASCII letter and a sign. The tokenizer's own pattern ends a token there in any
    case, so pieces have ids of their own, and a word is one piece whatever sign follows."""
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    if n > 2:
        solid, filled, high = _SOLID[buf], _FILLED[buf], buf >= 128
        inner = (solid[:-2] & (solid[2:] | high[2:])) | (high[:-2] & filled[2:])
        space, line = inner & (buf[1:-1] == 32), inner & (buf[1:-1] == 10)
        first[1:n - 1] |= space | line
        first[2:n] |= line & filled[2:]  # a wider character may be a blank that goes with the line end
    if n > 1:
        first[1:n] |= _LETTER[buf[:-1]] & _SIGN[buf[1:]]
    return np.flatnonzero(first[:n])


class Encoder:
    """Ids of whole texts from the tokenizers library, with its defaults. A piece is encoded once and remembered by its text.

    Pieces that begin with a space and end without one keep their ids next to each other, so new ones go through the library
    joined to long strings; the bytes that ids stand for tell where a piece ends. Those of a space and letters are one token of
    the byte-level pattern each, so for them the library splits at spaces instead of matching the pattern. Others go alone, and a
    text that holds the string of an added token goes whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Metaspace
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(token)  # the vocabulary writes every byte as one character
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.of_words = None
        if said.get("normalizer") is None and {k: v for k, v in (said.get("pre_tokenizer") or {}).items() if k != "trim_offsets"} == _BYTE_LEVEL:
            self.of_words = Tokenizer.from_file(path)
            self.of_words.pre_tokenizer = Metaspace(replacement=_AS_CHARACTERS[32], prepend_scheme="never")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int32)  # slices that held the piece

    def _forget_rare(self) -> None:
        """Keeps the half of the pieces that most slices held."""
        pieces, slots = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        kept = np.sort(np.argsort(-self.seen[slots], kind="stable")[:KNOWN_PIECES // 2])
        self.known = dict(zip([pieces[i] for i in kept.tolist()], range(len(kept))))
        at, self.size, self.seen = self.at[slots[kept]], self.size[slots[kept]], self.seen[slots[kept]] >> 1
        ends = np.cumsum(self.size)
        self.flat = self.flat[np.arange(self.size.sum()) + np.repeat(at + self.size - ends, self.size)]
        self.at = ends - self.size

    def _alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        flat, size = [np.zeros(0, np.uint32)], []
        for i in range(0, len(pieces), PIECES_AT_ONCE):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[i:i + PIECES_AT_ONCE]], add_special_tokens=False)]
            size += map(len, lists)
            flat.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32))
        return np.concatenate(flat), np.array(size, np.int64)

    def _joined(self, pieces: list[bytes], tokenizer, written) -> tuple[np.ndarray, np.ndarray]:
        """The same from strings of many pieces; ``written`` turns their bytes into what this tokenizer reads."""
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), PIECES_AT_ONCE):
            part = pieces[i:i + PIECES_AT_ONCE]
            stop = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            cuts = [0, *(np.flatnonzero(np.diff(stop // JOINED_BYTES)) + 1).tolist(), len(part)]
            strings = [written(b"".join(part[a:b])) for a, b in itertools.pairwise(cuts)]
            lists = [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32)
            reached = np.cumsum(self.id_bytes[ids])
            upto = np.searchsorted(reached, stop) + 1
            if len(ids) and (reached[np.minimum(upto - 1, len(reached) - 1)] == stop).all():
                flat.append(ids)
                size.append(np.diff(upto, prepend=0))
            else:  # an id reaches over a piece's end
                alone = self._alone(part)
                flat.append(alone[0])
                size.append(alone[1])
        return np.concatenate(flat), np.concatenate(size)

    def _kinds(self, pieces: list[bytes]) -> np.ndarray:
        """Of each piece: 0 goes alone, 1 goes joined, 2 is a space and ASCII letters, 3 a space and letters up to U+027F."""
        raw = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(size) - size
        second, last = raw[np.minimum(first + 1, len(raw) - 1)], raw[first + size - 1]
        joined = (size > 1) & (raw[first] == 32) & _FILLED[second] & _CLOSES[last]
        if self.of_words is None:
            return joined.astype(np.int8)
        rank = _WORD_RANK[raw[:-1]]
        rank[(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = 2  # the signs for times and divided by
        rank[first[joined]] = 0
        worst = np.maximum.reduceat(rank, first)
        return np.where(joined, np.array([2, 3, 1], np.int8)[worst], 0)

    def _learn(self, pieces: list[bytes]) -> None:
        kinds = self._kinds(pieces)
        for kind, encode in ((0, self._alone), (1, lambda p: self._joined(p, self.tokenizer, bytes.decode)),
                             (2, lambda p: self._joined(p, self.of_words, bytes.decode)),
                             (3, lambda p: self._joined(p, self.of_words, lambda b: b.decode("latin-1").translate(_AS_CHARACTERS)))):
            mine = [pieces[i] for i in np.flatnonzero(kinds == kind).tolist()]
            if mine:
                ids, size = encode(mine)
                self.known.update(zip(mine, range(len(self.at), len(self.at) + len(mine))))
                self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
                self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
                self.seen = np.concatenate([self.seen, np.zeros(len(mine), np.int32)])

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row)."""
        start = cut_places(buf, offsets)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        raw = buf.tobytes()
        for token in self.added:
            start = _uncut(start, offsets, raw, token)
        stop = np.append(start[1:], len(buf))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(buf))), pa.py_buffer(raw)]).dictionary_encode()
        distinct = _byte_strings(pieces.dictionary)
        if len(self.known) > KNOWN_PIECES:
            self._forget_rare()
        slots = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown.tolist()]
            self._learn(new)
            slots[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.seen[slots] += 1
        slot = slots[pieces.indices.to_numpy()]
        at, size = self.at[slot], self.size[slot]
        ends = np.cumsum(size)
        out = self.flat[np.arange(ends[-1]) - np.repeat(ends - size - at, size)].astype(np.int64)
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        return out, np.diff(bounds)


def _byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a large_binary column of its own buffers, without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    raw = column.buffers()[2].to_pybytes()
    return [raw[i:j] for i, j in itertools.pairwise(at)]


def _uncut(start: np.ndarray, offsets: np.ndarray, raw: bytes, token: bytes) -> np.ndarray:
    """The cut places without those inside rows that hold the token."""
    rows, at = [], raw.find(token)
    while at >= 0:
        rows.append(at)
        at = raw.find(token, at + 1)
    if not rows:
        return start
    row = np.unique(np.searchsorted(offsets, rows, "right") - 1)
    inside = np.isin(np.searchsorted(offsets, start, "right") - 1, row) & ~np.isin(start, offsets[row])
    return start[~inside]


def tokenizer_path(name: str) -> str:
    """A tokenizer file: a path, or the name of one of the public ones."""
    if os.sep in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _encoder(name: str) -> Encoder:
    encoders = kept_by_worker("encoders")  # with the pieces they know
    if name not in encoders:
        encoders[name] = Encoder(tokenizer_path(name))
    return encoders[name]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def _byte_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + ENCODE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _then_give_back(work):
    """``work`` on a task's batches; once its arrays are gone the worker gives back their memory."""
    def task(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back_memory()
    return task


MANIFEST = "part int, file string, docs long, tokens long"


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, out, encoder = TaskContext.get().partitionId(), None, None
        held, n_held, docs, lengths = [], 0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = _encoder(tokenizer)
                store, where = pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
                store.create_dir(where, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"  # a name of this attempt's own
                out = store.open_output_stream(f"{where}/{name}", compression=None)
                out.write(MAGIC)
            buf, offsets = text_bytes(batch.column(1))
            docs.append(batch.column(0))
            for i, j in _byte_slices(offsets):
                ids, counts = _with_end(*encoder.ids(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), end_id)
                lengths.append(counts)
                held.append(ids.astype(np.uint32))
                n_held += len(ids)
                while n_held >= CHUNK:
                    whole = np.concatenate(held)
                    _put(out, encode_chunk(whole[:CHUNK].astype(np.int64)))
                    held, n_held = [whole[CHUNK:]], n_held - CHUNK
        if out is None:
            return
        if n_held:
            _put(out, encode_chunk(np.concatenate(held).astype(np.int64)))
        lengths = np.concatenate(lengths)
        keys = pa.chunked_array(docs).combine_chunks()
        index = pa.BufferOutputStream()
        with pa.ipc.new_stream(index, pa.schema([("doc", pa.int64()), ("n", pa.int64())])) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(lengths)], ["doc", "n"]))
        tail = zlib.compress(index.getvalue().to_pybytes(), 6)
        out.write(struct.pack("<Q", 0))  # no further chunk
        out.write(tail + struct.pack("<QI", len(tail), zlib.crc32(tail)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(lengths)]), pa.array([int(lengths.sum())])],
                                         [f.split()[0] for f in MANIFEST.split(", ")])
    return _then_give_back(write)


def _put(out, chunk: bytes) -> None:
    out.write(struct.pack("<Q", len(chunk)))
    out.write(chunk)


def read_file(store: pafs.FileSystem, path: str) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """(doc, n of every document, the ids chunk by chunk)."""
    with store.open_input_file(path) as f:
        size = f.size()
        n, check = struct.unpack("<QI", f.read_at(12, size - 12))
        tail = f.read_at(n, size - 12 - n)
        if f.read_at(8, 0) != MAGIC or zlib.crc32(tail) != check:
            raise ValueError(f"{path} is damaged")
    index = pa.ipc.open_stream(zlib.decompress(tail)).read_all()

    def chunks() -> Iterator[np.ndarray]:
        with store.open_input_file(path) as f:
            f.seek(8)
            while (length := struct.unpack("<Q", f.read(8))[0]):
                yield decode_chunk(f.read(length))[0]
    return index, chunks()


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        for batch in batches:
            for name, base in zip(batch["file"], batch["base"]):
                index, chunks = read_file(store, f"{where}/{name}")
                n = index["n"].to_numpy()
                keys, start = index["doc"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), base + np.cumsum(n) - n
                checks, held, doc = np.zeros(len(n), np.int64), np.zeros(0, np.int64), 0
                crc, left = 0, int(n[0])
                for ids in chunks:  # documents may go on in the next chunk
                    raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                    while at < len(ids):
                        take = min(left, len(ids) - at)
                        crc = zlib.crc32(raw[4 * at:4 * (at + take)], crc)
                        at, left = at + take, left - take
                        if not left:
                            checks[doc], doc, crc = crc, doc + 1, 0
                            left = int(n[doc]) if doc < len(n) else 0
                if doc != len(n):
                    raise ValueError(f"{name} ends early")
                yield pd.DataFrame({"doc_id": keys, "start": start, "n_tokens": n, "ids_crc32": checks})
    return _then_give_back(read)


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                      end_id: int = END_ID) -> DataFrame:
    """Writes the files in ascending key order and returns their staged manifest (part, file, docs, tokens).

    Null texts are empty and get the end id alone; null keys come first; rows that share a key follow each other by text.
    Ranges of (key, text) are dealt to tasks, so a key with most rows is split. Files of attempts that were lost are in no
    manifest row. An empty table gives an empty manifest.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc", "h").sortWithinPartitions("doc", "h", "text").select("doc", "text")
    return staged(placed.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of the manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())
    return files.select("file", "base").repartition(n, "file").mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **options), folder)
