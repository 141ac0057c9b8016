"""Brute-force versions of the operators."""

import re
import zlib
from collections import Counter
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removed_places(docs, size):
    """Places covered by windows that also start in a document of smaller id;
    ``docs`` holds (id, sequence)."""
    least = {}
    for i, x in docs:
        for p in range(len(x) - size + 1):
            key = x[p : p + size] if isinstance(x, bytes) else tuple(x[p : p + size])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, x in docs:
        gone = set()
        for p in range(len(x) - size + 1):
            key = x[p : p + size] if isinstance(x, bytes) else tuple(x[p : p + size])
            if least[key] < i:
                gone.update(range(p, p + size))
        out.append(gone)
    return out


def spans(gone):
    out = []
    for p in sorted(gone):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(s, e - s) for s, e in out]


def shingle_set(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_components(docs):
    """id -> smallest id reachable over links."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def quality_base(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    places = set()
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            places |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(places)


def sha(data):
    return sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
