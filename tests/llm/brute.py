"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

sha = lambda b: hashlib.sha256(b).hexdigest()


def repeated_words(rows, length=35):
    """rows: (doc_id, text) with distinct doc_ids."""
    words = {d: (t or "").encode().split() for d, t in rows}
    seen = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_bytes(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            x = b[i : i + length]
            if x in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(x)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def near_duplicates(rows, percent=75):
    """doc_id -> (n_shingles, component_id, kept), by an index of shingles."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    for d, s in sets.items():
        shared = Counter(o for x in s for o in index[x] if o < d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def base_scores(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    import math
    import zlib

    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = {d: [*(t or "").encode().translate(lower).split(), None] for d, t in rows}
    c = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    shift = math.log10(n + 0.5 * (v + 1))
    return {d: (held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(c[w] + 0.5) - shift for w in ws)) for d, ws in tokens.items()}


def model_scores(rows, priors):
    """doc_id -> log10 probability by hierarchical Dirichlet smoothing of all n-grams up to three, counted in dictionaries."""
    import math
    import zlib

    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = {d: ["<", *(t or "").encode().translate(lower).split(), ">"] for d, t in rows}
    learned = [ws for d, ws in tokens.items() if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    grams = Counter(tuple(ws[i - k : i + 1]) for ws in learned for i in range(1, len(ws)) for k in range(min(i, 2) + 1))
    total, distinct = sum(len(ws) - 1 for ws in learned), sum(len(g) == 1 for g in grams)
    seen = lambda h: len(learned) if h == ("<",) else grams[h]

    def p(h, w):
        if not h:
            return (grams[(w,)] + priors[0] / (distinct + 1)) / (total + priors[0])
        k = priors[len(h)]
        return (grams[(*h, w)] + k * p(h[1:], w)) / (seen(h) + k)

    return {d: sum(math.log10(p(tuple(ws[max(0, i - 2) : i]), ws[i])) for i in range(1, len(ws))) for d, ws in tokens.items()}


def kneser_ney(texts):
    """P(byte | three before) as a function of four bytes, from the byte strings to learn from."""
    grams = {4: Counter(p[i : i + 4] for t in texts for p in [b"\0\0\0" + t] for i in range(len(t)))}
    for k in (3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    tables = {}
    for k in (1, 2, 3, 4):
        n = Counter(min(c, 5) for c in grams[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else 0.5 * i for i in (1, 2, 3)}
        total, left = Counter(), Counter()
        for g, c in grams[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        tables[k] = (grams[k], d, total, left)

    def p(g):
        if not g:
            return 1 / 256
        n, d, total, left = tables[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        c = n[g]
        return (max(c - d[min(c, 3)], 0) if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def quality_verdicts(rows, least_docs):
    """doc_id -> (kept, log perplexity) of (doc_id, text, lang)."""
    import math

    n = Counter(lang for _, _, lang in rows)
    model = {d: lang if lang is not None and n[lang] >= least_docs else "*" for d, _, lang in rows}
    data = {d: (t or "").encode() for d, t, _ in rows}
    prose = {d for d, t in data.items() if len(t.split()) >= 50 and 200 * sum(t.count(c) for c in b"#*$%&|<>") <= len(t.decode())}
    models = {m: kneser_ney([data[d] for d in prose if model[d] == m]) for m in set(model.values())}
    ppl = {}
    for d, t in data.items():
        padded, p = b"\0\0\0" + t, models[model[d]]
        cache = {}
        total = 0.0
        for i in range(len(t)):
            g = padded[i : i + 4]
            if g not in cache:
                cache[g] = math.log(p(g))
            total += cache[g]
        ppl[d] = -total / max(1, len(t))
    bands = {}
    for m in models:
        v = sorted(round(ppl[d], 3) for d, t in data.items() if model[d] == m and len(t.split()) >= 50)
        if v:
            at = lambda q, v=v: v[int(q * (len(v) - 1))] + (q * (len(v) - 1) % 1) * (v[min(len(v) - 1, int(q * (len(v) - 1)) + 1)] - v[int(q * (len(v) - 1))])
            spread = max(at(0.75) - at(0.25), 0.03)
            bands[m] = (at(0.25) - 4 * spread, at(0.75) + 4 * spread)
    out = {}
    for d, t in data.items():
        w = t.split()
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(three)
        again = len({i + k for i, x in enumerate(three) if seen[x] > 1 for k in range(3)})
        low, high = bands.get(model[d], (-math.inf, math.inf))
        out[d] = (not (len(w) < 50 or 100 * again > 50 * len(w)) and low <= ppl[d] <= high, ppl[d])
    return out
