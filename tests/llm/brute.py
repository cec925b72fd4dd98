"""Plain versions of the operators, for small tables."""
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=5):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def components(rows, k=5, threshold=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sets:
        for x in s:
            where.setdefault(x, []).append(i)
    by = dict(sets)
    near = {(p, q) for ids in where.values() for p in ids for q in ids if p < q}
    for p, q in near:
        both = len(by[p] & by[q])
        if 100 * both >= threshold * len(by[p] | by[q]):
            a, b = sorted((root(p), root(q)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def substring_dedup(rows, k=13):
    import hashlib

    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - k + 1):
            key = tuple(w[p:p + k])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < i:
                gone.update(range(p, p + k))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
