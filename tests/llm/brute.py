"""Plain Python versions of the training-data operators, for small tables."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MASK = (1 << 64) - 1


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower_az(text or ""))


def near_classes(docs, threshold=0.8, size=5):
    """{id: smallest id connected by links}; docs: {id: text}."""
    bags = {}
    for i, t in docs.items():
        w = words(t)
        bags[i] = collections.Counter(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else None
    parent = {i: i for i in docs}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if bags[a] is None or bags[b] is None:
                near = bags[a] is None and bags[b] is None and (docs[a] or "") == (docs[b] or "")
            else:
                both = sum((bags[a] & bags[b]).values())
                near = both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both)
            if near:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in docs}


def contamination(docs, items, window=13):
    """{id: (n_words, n_hit, sorted item ids as strings)}."""
    grams = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k:k + n])].add(item)
    sizes = {len(g) for g in grams}
    out = {}
    for i, text in docs.items():
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = grams.get(tuple(w[k:k + n]))
                if got is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _xx(values, seed=42):
    """Spark's xxhash64 over columns: ("s", text), ("i", int32), ("l", int64); None is skipped."""
    h = seed
    for kind, v in values:
        if v is None:
            continue
        raw = v.encode() if kind == "s" else (v & ((1 << (32 if kind == "i" else 64)) - 1)).to_bytes(4 if kind == "i" else 8, "little")
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def line_dedup(docs, scales, min_lines, min_words, numbers=False):
    """{id: (text or None, removed lines)}; docs: {id: text or None} with distinct ids.  ``numbers``: {id: removed line numbers}."""
    found = collections.defaultdict(list)
    for i, text in docs.items():
        if text is None:
            continue
        lines = text.split("\n")
        h = [_signed(_xx([("s", x)])) for x in lines]
        spans = set()
        for k, (window, divisor) in enumerate(scales):
            first = 0
            for j in range(1, len(lines) + 1):
                rolling = [("i", k)] + [("l", h[j - w - 1] if j - w - 1 >= 0 else None) for w in range(window)]
                own = [("i", k + 100), ("l", h[j] if j < len(lines) else None)]
                if j == len(lines) or _signed(_xx(rolling)) % divisor == 0 or _signed(_xx(own)) % divisor == 0:
                    spans.add((first, j - first))
                    first = j
        for a, n in spans:
            chunk = "\n".join(lines[a:a + n])
            if n >= min_lines or len(re.findall(r"\S+", chunk)) >= min_words:
                found[(n, chunk)].append((i, a))
    gone = collections.defaultdict(set)
    for (n, _), places in found.items():
        for i, a in sorted(places)[1:]:
            gone[i].update(range(a, a + n))
    if numbers:
        return dict(gone)
    return {i: (t if t is None or not gone[i] else
                "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i]))
            for i, t in docs.items()}


def pagerank(edges, seeds, damping, steps):
    out = collections.defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(seeds)
    for _ in range(steps):
        new = collections.defaultdict(float)
        for h, s in seeds.items():
            new[h] += (1 - damping) * s
        for (a, b), w in edges.items():
            new[b] += damping * score.get(a, 0.0) * w / out[a]
        score = new
    return score


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
