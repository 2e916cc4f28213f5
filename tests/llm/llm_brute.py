"""Plain restatements of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UP, LOW)


def first(x, y):
    """Nulls come last."""
    return (x is None, x) < (y is None, y)


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def link(self, i, j):
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near(rows, percent=85):
    """``(doc_id, n, component, kept)`` of ``(doc_id, text)`` rows."""
    return near_and_roots(rows, percent)[0]


def near_and_roots(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    g = Groups(len(rows))
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j > i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                g.link(i, j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[g.find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[g.find(i)] if x is not None]
        c = min(known) if known else None
        out.append((d, len(sets[i]), c, d == c))
    return out, [g.find(i) for i in range(len(rows))]


def repeats(rows, length=100):
    """``(doc_id, n_bytes, n_removed, n_spans, sha256)``; rows with equal id and text are one."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, result = {}, {}
    starts = []
    for z, d, t in order:
        b = t.encode()
        for s in range(len(b) - length + 1):
            key = (z, d, s)
            x = b[s : s + length]
            if x not in seen or key < seen[x]:
                seen[x] = key
        starts.append((z, d, t, b))
    for z, d, t, b in starts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (z, d, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        result[z, d, t] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return [(d, *result[d is None, d or 0, t or ""]) for d, t in rows]


def leaks(rows, items):
    """``(doc_id, n_words, n_hit, n_items, sha256, contaminated)``."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(FOLD))
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows[tuple(w[k : k + m])].add(i)
    lengths = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w = word.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    hit.update(range(k, k + m))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), sha, bool(hit)))
    return out


def vectors(rows, link=0.95):
    """``(vec_id, n_links, component, kept)``."""
    import numpy as np

    def usable(v):
        return (
            v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
        )

    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    g, n = Groups(len(rows)), [0] * len(rows)
    for a, i in enumerate(good):
        for j in good[a + 1 :]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= link:
                n[i] += 1
                n[j] += 1
                g.link(i, j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[g.find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[g.find(i)] if x is not None]
        c = min(known) if known else None
        out.append((d, n[i], c, d == c))
    return out
