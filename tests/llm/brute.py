"""Plain-Python versions of what the operators compute, for small tables."""

from collections import Counter, defaultdict
from itertools import combinations


def words(text):
    return (text or "").encode().split()


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_pairs(sets, threshold=0.8):
    """Pairs of keys whose sets reach the threshold."""
    by = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    shared = Counter(p for ks in by.values() for p in combinations(sorted(ks), 2))
    return [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= threshold]


def classes(sets, threshold=0.8):
    """key -> (class, links)."""
    union, links = Union(sets), Counter()
    for a, b in near_pairs(sets, threshold):
        union.join(a, b)
        links[a] += 1
        links[b] += 1
    return {k: (union.find(k), links[k]) for k in sets}
