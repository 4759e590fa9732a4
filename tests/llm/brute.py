"""Plain Python twins of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard(docs, k, num, den):
    """{doc_id: (n, component)} for distinct ids."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    ids = sorted(sets)
    holders = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            holders[s].append(d)
    near = {(a, b) for h in holders.values() if len(h) < 400 for i, a in enumerate(h) for b in h[i + 1 :]}
    links = [(a, b) for a, b in near if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    label = components(ids, links)
    return {d: (len(sets[d]), label[d]) for d in ids}


def windows_removed(docs, window, split=words):
    """{doc_id: (n, removed positions)}; documents in ascending id."""
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), (d, i)) != (d, i):
                gone |= set(range(i, i + window))
        out[d] = (w, gone)
    return out


def lines_kept(docs, window, long_words):
    """{doc_id: kept text}"""
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        lines = t.split("\n") if t else []
        gone = set()
        for size in (window, 1):
            for i in range(len(lines) - size + 1):
                run = tuple(lines[i : i + size])
                if size == 1 and window != 1 and len(words(run[0])) < long_words:
                    continue
                if seen.setdefault(run, (d, i)) != (d, i):
                    gone |= set(range(i, i + size))
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        got = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if got[s] > most * sizes[s]}
        if not over:
            return {**{s: float(most * sizes[s]) for s in full}, **got}
        full |= over


def vectors(rows, cosine):
    """{id: (links, component)} for distinct ids."""
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    ids = [i for i, _ in rows]
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine]
    label = components(ids, links)
    return {i: (sum(i in x for x in links), label[i]) for i in ids}


def crc(data):
    return zlib.crc32(data)
