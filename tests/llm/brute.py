"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w]


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}


def components(docs, n, num, den):
    """{id: smallest id reachable} of (id, text) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in docs}
    holders, shared = defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for x in sets[i]:
            for j in holders[x]:
                shared[j, i] += 1
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), both in shared.items():
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def units(text):
    """Lines with their line feeds, cut after sentence marks before a blank or tab."""
    return [u for u in re.split(r"(?<=\n)|(?<=[.!?])(?=[ \t])", text or "") if u]


def unit_key(unit):
    return re.sub(r"[\x20\x09-\x0D]", "", unit.translate(LOWER))


def without_repeats(docs, least):
    """{id: text} after repeated units go, in runs of `least` words."""
    first = {}
    for i, text in sorted(docs):
        for k, u in enumerate(units(text)):
            first.setdefault(unit_key(u), (i, k))
    out = {}
    for i, text in docs:
        us = units(text)
        again = [unit_key(u) == "" or first[unit_key(u)] != (i, k) for k, u in enumerate(us)]
        keep, k = [True] * len(us), 0
        while k < len(us):
            stop = k
            while stop < len(us) and again[stop]:
                stop += 1
            solid = [x for x in range(k, stop) if unit_key(us[x])]
            if solid and sum(len(words(us[x])) for x in range(k, stop)) >= least:
                keep[solid[0]:solid[-1] + 1] = [False] * (solid[-1] + 1 - solid[0])
            k = max(stop, k + 1)
        out[i] = "".join(u for u, x in zip(us, keep) if x)
    return out


def tokens(text):
    return [t.lower() for t in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text or "")]


def best_overlap(a, b, penalty):
    """Longest best-scoring stretch over all diagonals of two token lists: (length, matches)."""
    best = (0, 0)
    for d in range(-len(b) + 1, len(a)):
        lo, hi = max(0, d), min(len(a), d + len(b))
        score = start = top = 0
        start = lo
        for k in range(lo, hi):
            score += 1 if a[k] == b[k - d] else -penalty
            if score <= 0:
                score, start = 0, k + 1
            elif score > top:
                top = score
                best = max(best, (k + 1 - start, top))
    return best


def lines_held_before(docs, least):
    """{id: lines that go}: those in blocks of `least` words that an earlier (id, text) has; blank lines part nothing."""
    out, before = {}, []
    for i, text in sorted(docs):
        full = [(k, unit_key(x), len(words(x))) for k, x in enumerate(text.splitlines()) if unit_key(x)]
        keys, out[i] = [x for _, x, _ in full], set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                n = b - a
                if not any(keys[a:b] == other[k:k + n] for other in before for k in range(len(other) - n + 1)):
                    break
                if sum(x for _, _, x in full[a:b]) >= least:
                    out[i].update(range(full[a][0], full[b - 1][0] + 1))
        before.append(keys)
    return out


def alike(a, b, least, masks):
    """Does a diagonal of two token lists that a mask hits have `least` tokens between two matches, or all of b, with 4 of 5 equal?"""
    for d in range(-len(b) + 1, len(a)):
        lo, hi = max(0, d), min(len(a), d + len(b))
        same = [a[k] == b[k - d] for k in range(lo, hi)]
        if any(all(same[k + x] for x, c in enumerate(m) if c == "1") for m in masks for k in range(len(same) - len(m) + 1)):
            if len(same) == len(b) and 5 * sum(same) >= 4 * len(b):
                return True
            for x in range(len(same)):
                if any(same[x] and same[y - 1] and 5 * sum(same[x:y]) >= 4 * (y - x) for y in range(x + least, len(same) + 1)):
                    return True
    return False
