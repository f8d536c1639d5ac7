"""Plain versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words(text)
    if 0 < len(w) < size:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def jaccard(a, b):
    common = sum((a & b).values())
    return common / max(sum(a.values()) + sum(b.values()) - common, 1)


def classes(rows, threshold=0.8):
    """Smallest id of each (id, text)'s class; ids are unique."""
    bags = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = dict(rows)
    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] is None or texts[b] is None:
                continue
            if texts[a] == texts[b] or (bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= threshold):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
