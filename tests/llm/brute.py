"""Plain definitions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw(text) -> bytes:
    return (text or "").encode()


def components(rows) -> dict:
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with different ids."""
    sets = {}
    for i, text in rows:
        w = SPACE_WORD.findall(raw(text).translate(_LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        overlap = Counter(j for s in sets[i] for j in seen[s])
        for s in sets[i]:
            seen[s].append(i)
        for j, o in overlap.items():
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def kept_bytes(rows, window=50) -> list:
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] of (doc_id, text) rows."""
    first = {}
    for i, text in rows:
        b = raw(text)
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        b = raw(text)
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def contamination(text, items) -> tuple:
    """(n_words, n_hit, item ids) of one text; ``items`` are (id, text)."""
    words = ALNUM_WORD.findall(raw(text).translate(_LOWER))
    hit, ids = set(), set()
    for item, other in items:
        w = ALNUM_WORD.findall(raw(other).translate(_LOWER))
        m = min(10, len(w))
        windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
        for k in range(len(words) - m + 1 if m else 0):
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def spots(text, common: str, gap: int) -> set:
    """Spot signatures of a text as word tuples; chains of two neighbouring content words."""
    w = ALNUM_WORD.findall(raw(text).translate(_LOWER))
    known = set(ALNUM_WORD.findall(common.encode().translate(_LOWER)))
    out = set()
    for k, word in enumerate(w):
        before = [j for j in range(k + 1) if w[j] in known]
        if word in known or not before or k - before[-1] > gap:
            chain = [x for x in w[k + 1 :] if x not in known][:2]
            out.add((word, *chain))
    return out


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows) -> dict:
    """{doc_id: edited text} of (doc_id, text) rows with different ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out[i] = t[: len(t) - half] + following[:half]
    return out


def fill_in_middle(doc_id, text) -> tuple:
    text = text or ""
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


def vector_codes(rows, parts=16, entries=64, rounds=2) -> tuple[dict, list]:
    """({vec_id: (code, error)}, codebooks) in Python integers; rows are (vec_id, vector) with different ids."""
    import math

    kept = {i: [math.floor(x * 256) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    cut = {i: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for i, v in kept.items()}
    books = [[cut[i][p] for i in sorted(kept)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, part: min(range(len(books[p])), key=lambda k: (far(part, books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for i in kept:
                members[best(p, cut[i][p])].append(cut[i][p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if members[k] else e for k, e in enumerate(books[p])]
    out = {}
    for i in kept:
        code = [best(p, cut[i][p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for k in code), sum(far(cut[i][p], books[p][k]) for p, k in enumerate(code))
    return out, books


def licences(names: list, rules: list) -> tuple[list, list]:
    """(licences in text order, identifiers left): the longest rules first, each wherever its names stand in a row."""
    left, out = dict(enumerate(names)), {}
    for length in sorted({len(rule) for _, rule in rules}, reverse=True):
        for licence, rule in rules:
            if len(rule) != length:
                continue
            for k in range(len(names)):
                if all(left.get(k + j) == name for j, name in enumerate(rule)):
                    out[k] = licence
                    for j in range(length):
                        del left[k + j]
    return [out[k] for k in sorted(out)], [left[k] for k in sorted(left)]
