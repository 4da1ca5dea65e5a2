"""Plain Python forms of the operators, for small inputs."""

from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    width = min(width, len(w))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(texts, width, percent):
    """{id: least linked id} over all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in having[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            having[s].append(i)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}
