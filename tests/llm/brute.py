"""Plain versions of the operators, row by row, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def near_duplicates(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps))


def secrets(text):
    text = text or ""
    found = []
    for kind, (name, pattern, ok) in enumerate((
        ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )):
        found += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text) if ok(m)]
    found.sort()
    n = Counter(x[3] for x in found)
    joined = ",".join(f"{name}:{a}:{z}" for a, _, z, name in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def dedup_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    docs = defaultdict(set)
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(order(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs.get(key(x), ())) >= 3 and order(i) != max(docs[key(x)]))]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def leaks(rows, items, similarity=0.8):
    def tok(t):
        return re.findall(r"\w+", (t or "").lower())

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = {}
    for doc, t in rows:
        w = tok(t)
        for item, it in items:
            x = tok(it)
            if not x:
                continue
            a, best = grams(x), 0.0
            vocabulary = set(x)
            if len(vocabulary & set(w)) < 0.5 * len(vocabulary):
                continue
            for at in range(len(w) - len(x) + 1):
                b = grams(w[at : at + len(x)])
                shared = sum((a & b).values())
                best = max(best, shared / (sum(a.values()) + sum(b.values()) - shared))
            if best >= similarity:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def targets(sizes):
    """Share out by weight again and again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, pool = set(), 1.5 * sum(sizes.values())
    while True:
        left = pool - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / total for s in names}
        over = {s for s in names if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def token_rows(rows, tokenizer):
    """Rows in ascending id order; those of one id may come in any order, so their ids are checked as a set by the caller."""
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def spans(text):
    """All spans of the secret scan: the base ones, and runs of key characters with a window of high entropy that no base span holds."""
    from math import log2

    text = text or ""
    kinds = ("assign", "access", "hex", "entropy")
    found = [
        *[(m.start(), 0, m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8],
        *[(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        *[(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32],
    ]
    base = sorted(found)
    reach = [0]
    for s in base:
        reach.append(max(reach[-1], s[2]))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        parts = [x for x in re.split(r"[+/_=-]+", run) if x]
        words = all(x.isalpha() or x.isdigit() and len(x) <= 4 for x in parts)
        if words or all(x.isdigit() for x in parts) or re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
            continue
        limit = 3.0 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) else 3.6 if run.isalnum() else 3.8
        counts, best = Counter(), 0.0
        for i, c in enumerate(run):
            counts[c] += 1
            if i >= 20:
                counts[run[i - 20]] -= 1
            if i >= 19:
                best = max(best, -sum(k / 20 * log2(k / 20) for k in counts.values() if k))
        before = sum(1 for s in base if s[0] <= m.start())
        if best >= limit and reach[before] < m.end():
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in sorted(found))
