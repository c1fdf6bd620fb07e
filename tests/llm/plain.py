"""Plain reimplementations to compare with."""

from __future__ import annotations

from collections import Counter, defaultdict


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(texts: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    """Component of every document, from all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    where, shared, union = defaultdict(list), Counter(), Union(sets)
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in where[x])
            where[x].append(i)
    for (a, b), same in shared.items():
        if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            union.join(a, b)
    return {i: union.root(i) for i in sets}
