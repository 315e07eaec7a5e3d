"""Plain-Python answers for small tables, written apart from the operators."""
import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def contamination(docs, items, window=10):
    """docs, items: (id, text); rows (id, n_words, n_hit, n_items, sha, contaminated)."""
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add(i)
    sizes = {len(p) for p in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k:k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[p]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text, width=4):
    w = BLANK.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    """Smallest index of each index's component under linked(i, j)."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j) and (a := top(i)) != (b := top(j)):
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def simhash(docs, bits=4):
    """(id, hex fingerprint, component id) of each (id, text)."""
    f = [fingerprint(t) for _, t in docs]
    c = classes(len(docs), lambda i, j: (f[i] ^ f[j]).bit_count() <= bits)
    low = {}
    for (d, _), x in zip(docs, c):
        if d is not None:
            low[x] = min(low.get(x, d), d)
    return [(d, f"{y:016x}", low.get(x)) for (d, _), y, x in zip(docs, f, c)]


def shards(docs, n=24):
    """(id, size, crc, shard, slot) of each (id, text), by the middle byte."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, zlib.crc32((r[1] or "").encode()))
    total = sum(len((t or "").encode()) + 8 for _, t in docs)
    out, at, slots = [], 0, {}
    for d, t in sorted(docs, key=key):
        size = len((t or "").encode()) + 8
        s = min(n - 1, (2 * at + size) * n // (2 * total))
        slots[s] = slots.get(s, -1) + 1
        out.append((d, size, None if t is None else zlib.crc32(t.encode()), s, slots[s]))
        at += size
    return out


def covered(a, b, t, similarity):
    """Positions of token lists a and b (each without repeats, the common ones in one order) in similar spans that begin and end alike."""
    place = {v: k for k, v in enumerate(b)}
    both = [(i, place[v]) for i, v in enumerate(a) if v in place]
    mine, other = set(), set()
    for k, (s, u) in enumerate(both):
        for e, w in both[k:]:
            p, q = set(a[s:e + 1]), set(b[u:w + 1])
            if min(len(p), len(q)) >= t and len(p & q) >= similarity * len(p | q):
                mine.update(range(s, e + 1))
                other.update(range(u, w + 1))
    return mine, other
