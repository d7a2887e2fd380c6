"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows):
    """[(class id, links)] of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    links, parts = [0] * len(rows), Sets(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parts.join(i, j)
    members = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            members[parts.root(i)].append(key)
    return [(min(members[parts.root(i)], default=None), links[i]) for i in range(len(rows))]


def removed(texts, length=400):
    """[(bytes, removed, spans, kept)] of byte strings that occur twice."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def passages(texts, width=51):
    """[[(begin, end)]] of the bytes of passages of as many words that occur twice."""
    raw = [(t or "").encode().decode("latin-1") for t in texts]
    places = [[m.span() for m in WORD.finditer(t)] for t in raw]
    windows = [[tuple(t[a:b] for a, b in p[i : i + width]) for i in range(len(p) - width + 1)] for t, p in zip(raw, places, strict=True)]
    count = collections.Counter(w for ws in windows for w in ws)
    out = []
    for ws, p in zip(windows, places, strict=True):
        spans = []
        for i, w in enumerate(ws):
            if count[w] > 1:
                a, b = p[i][0], p[i + width - 1][1]
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
        out.append(spans)
    return out


def cleaned(texts, length=400, width=51):
    """The texts without byte strings and passages of words that occur twice; None for a text that had a word and has none left."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for t, b, spans in zip(texts, raw, passages(texts, width), strict=True):
        gone = bytearray(len(b))
        for x, y in [(i, i + length) for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1] + spans:
            gone[x:y] = b"\1" * (y - x)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append(left if t is not None and (words(left) or not words(t)) else None)
    return out


def near_vectors(rows, threshold=0.93):
    """[(links, component, kept)] of rows (id, vector, label)."""
    ok = []
    for key, v, label in rows:
        fine = v is not None and label is not None and key is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)
        ok.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine else None)
    links, parts = [0] * len(rows), Sets(len(rows))
    for i, a in enumerate(ok):
        for j in range(i):
            b = ok[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parts.join(i, j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[parts.root(i)] = min(least.get(parts.root(i), key), key)
    return [(links[i], least.get(parts.root(i)), key is not None and key == least[parts.root(i)]) for i, (key, *_) in enumerate(rows)]
