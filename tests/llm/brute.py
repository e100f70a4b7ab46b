"""Plain single-process versions of the operators, for tests on small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(docs):
    """docs: [(doc_id, text)], ids distinct -> {doc_id: (n_words, n_removed, sha256 of the kept words)}."""
    first = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < d:
                gone[i:i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def repeated_bytes(docs):
    first, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            h = hashlib.blake2b(b[i:i + 100], digest_size=12).digest()
            if h in first:
                gone[i:i + 100] = b"\1" * 100
            first.add(h)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def near_components(docs):
    """{doc_id: (n_shingles, component_id)} for distinct ids."""
    s = {d: shingle_set(t) for d, t in docs}
    by = {}
    for d, x in s.items():
        for g in x:
            by.setdefault(g, []).append(d)
    root = {d: d for d in s}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for d, x in s.items():
        for e in {e for g in x for e in by[g] if e > d}:
            both = len(x & s[e])
            if 100 * both >= 80 * (len(x) + len(s[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s[d]), find(d)) for d in s}
