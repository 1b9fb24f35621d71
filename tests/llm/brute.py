"""Plain Python twins of the operators, for small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text, width=4):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows, width=4, percent=85):
    """rows: (doc_id, text) of distinct ids; candidates from an index of all shingles."""
    sets = {i: shingles(t, width) for i, t in rows}
    index, links = {}, []
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in index.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            index[x].append(i)
        links += [(i, j) for j, c in shared.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    comp = smallest_reachable(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}
