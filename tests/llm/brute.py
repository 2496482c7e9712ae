"""Plain re-statements of what the operators must give, for small inputs."""

from __future__ import annotations

import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def runs(text, n):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def smallest_reachable(ids, links):
    """The smallest id that each id reaches over links."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = top(a), top(b)
        if p != q:
            root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def copy_groups(rows, n, percent):
    """{id: (n_shingles, component)} of (id, text) rows."""
    sets = [(i, runs(t, n)) for i, t in rows]
    links = [
        (a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :]
        if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t)
    ]
    return smallest_reachable({i for i, _ in rows if i is not None}, links), sets


def cosine(u, v):
    return sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u)) / math.sqrt(sum(b * b for b in v))


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0
