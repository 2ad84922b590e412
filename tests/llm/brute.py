"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def removed_repeats(texts: dict, length: int = 400) -> dict:
    """{id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    raws = {k: (t or "").encode() for k, t in texts.items()}
    seen: dict[bytes, int] = {}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            h = hashlib.blake2b(raw[i:i + length], digest_size=12).digest()
            seen[h] = seen.get(h, 0) + 1
    out = {}
    for k, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[hashlib.blake2b(raw[i:i + length], digest_size=12).digest()] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(texts: dict) -> dict:
    """{id: (n_shingles, component, kept)} with every pair that shares a shingle compared."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    holders: dict = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {(a, b) for hs in holders.values() for i, a in enumerate(hs) for b in hs[i + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}
