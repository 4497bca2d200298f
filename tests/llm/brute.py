"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = b" \t\n\x0b\x0c\r"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def covered(units, window, count):
    hit = [False] * len(units)
    for i in range(len(units) - window + 1):
        if count[units[i : i + window]] > 1:
            hit[i : i + window] = [True] * window
    return hit


def phrases(docs, window):
    words = {d: tuple((t or "").encode().split()) for d, t in docs}
    count = Counter(w[i : i + window] for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        hit = covered(w, window, count)
        out[d] = (len(w), sum(hit), sha(b" ".join(x for x, h in zip(w, hit) if not h)))
    return out


def suffixes(docs, window):
    data = {d: (t or "").encode() for d, t in docs}
    count = Counter(b[i : i + window] for b in data.values() for i in range(len(b) - window + 1))
    out = {}
    for d, b in data.items():
        hit = covered(b, window, count)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[d] = (len(b), sum(hit), spans, sha(bytes(x for x, h in zip(b, hit) if not h)))
    return out


def lines(docs, min_docs):
    keys = {d: [x.strip(SPACE) for x in (t or "").encode().lower().split(b"\n")] for d, t in docs}
    count = Counter(k for v in keys.values() for k in set(v) if k)
    out = {}
    for d, t in docs:
        rows = (t or "").encode().split(b"\n")
        kept = [r for r, k in zip(rows, keys[d]) if count[k] < min_docs]
        out[d] = (len(rows), len(rows) - len(kept), sha(b"\n".join(kept)))
    return out


def near(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def hits(docs, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[a : a + window])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
    return out
