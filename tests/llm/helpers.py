"""Plain Python versions of what the operators compute, for comparison."""

import re
from collections import Counter
from itertools import combinations

SPACE = re.compile(r"[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    w = words(lower(text or ""))
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class Groups(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def linked(ids, close):
    g = Groups()
    for a, b in combinations(sorted(ids), 2):
        if close(a, b):
            g.link(a, b)
    return {i: g.root(i) for i in ids}


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))
