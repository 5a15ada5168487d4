"""Plain Python versions of the operators, for tests."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

ASCII_BLANK = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def remove_lines(docs, window=3):
    """{(id, text): (new text, lines, removed)} by sorting all windows."""
    seen, starts = {}, defaultdict(set)
    solid = {}
    for key in set(docs):
        lines = [] if key[1] is None else key[1].split("\n")
        solid[key] = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
    for key in sorted(solid, key=lambda k: (k[0] is None, k[0] or 0)):
        lines = [] if key[1] is None else key[1].split("\n")
        keys = [lines[i].strip(" \t\r") for i in solid[key]]
        for p in range(len(keys) - window + 1):
            body = tuple(keys[p:p + window])
            if seen.setdefault(body, (key, p)) != (key, p):
                starts[key].add(p)
    out = {}
    for key, at in solid.items():
        gone = {at[p + k] for p in starts[key] for k in range(window)}
        text = key[1]
        if gone:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out[key] = (text, len(at), len(gone))
    return out


def simhash(text, n=4):
    words = ASCII_BLANK.findall(lower(text or ""))
    if not words:
        return 0
    grams = [words[i:i + n] for i in range(len(words) - n + 1)] or [words]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def components(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_duplicates(docs, n=4, bits=4):
    """[(id, fingerprint, smallest id reachable)]."""
    prints = [simhash(t, n) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= bits]
    comp = components(len(docs), links)
    least = {}
    for (i, _), c in zip(docs, comp):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    return [(i, p, least[c]) for (i, _), p, c in zip(docs, prints, comp)], comp


def decon_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower(text or ""))


def contained(docs, items, threshold=0.8, n=5):
    """[(doc id, item id, shingles, shared)]."""
    out = []
    for item, body in set(items):
        words = decon_words(body)
        if not words:
            continue
        k = min(n, len(words))
        grams = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
        for doc, text in docs:
            own = decon_words(text)
            shared = len(grams & {tuple(own[i:i + k]) for i in range(len(own) - k + 1)})
            if shared >= threshold * len(grams) - 1e-9:
                out.append((doc, item, len(grams), shared))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """{source: target}: capped sources out until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= epochs * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = epochs * sizes[s]
        left -= sum(out[s] for s in above)
        free -= above
    return out


def mix(docs):
    """{(id, source, size): [taken, ...]} of (id, text, source) rows."""
    rows, sizes = [], defaultdict(int)
    for i, text, source in docs:
        size = len(ASCII_BLANK.findall(text or ""))
        marks = len(re.findall(r"[|*#%&$!<>{}=+\\_^~@\[\]]", text or ""))
        u = (int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52
        key = -math.log(u) / (size / (size + marks) if size else 1.0)
        rows.append((source, key, i, size))
        sizes[source] += size
    goal, start, out = targets(sizes), defaultdict(int), defaultdict(list)
    for source, key, i, size in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2] is not None, r[2] or 0, r[3])):
        whole = math.floor(goal[source] / sizes[source]) if sizes[source] else 0
        rest = math.floor(goal[source]) - whole * sizes[source]
        out[(i, source, size)].append(whole * size + max(0, min(size, rest - start[source])))
        start[source] += size
    return {k: sorted(v) for k, v in out.items()}, goal


def crc(x, n):
    return zlib.crc32(str(x).encode()) % n
