"""Plain Python versions of what the corpus operators compute."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeated(seqs, width):
    """Per sequence: which places a window that starts more than once covers."""
    count = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        mask = [False] * len(s)
        for i in range(len(s) - width + 1):
            if count[tuple(s[i : i + width])] > 1:
                mask[i : i + width] = [True] * width
        out.append(mask)
    return out


def kept_digest(parts, mask, sep):
    return hashlib.sha256(sep.join(p for p, m in zip(parts, mask, strict=True) if not m)).hexdigest()


def components(docs, n, percent):
    """(n-grams, smallest linked id) per row of (id, text)."""
    sets = []
    for _, t in docs:
        w = words(fold(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)].append(k)
    return [(len(sets[i]), min(least[find(i)], default=None)) for i in range(len(docs))]


def backoff_scores(texts, order, factor, least):
    ws = [words(fold(t)) for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in ws for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, ws))

    def s(w, i, k):
        if k == 1:
            return count[(w[i],)] / total
        g = tuple(w[i - k + 1 : i + 1])
        return count[g] / count[g[:-1]] if count[g] >= least else factor * s(w, i, k - 1)

    return [sum(math.log(s(w, i, min(order, i + 1))) for i in range(len(w))) for w in ws]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets per source by repeated resharing. sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        rest = goal - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else t[s] for s in names}
        full |= over


def quality_counts(text):
    ws, t = words(text), text or ""
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count, mask = Counter(grams), [False] * len(ws)
    for i, g in enumerate(grams):
        if count[g] > 1:
            mask[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mask)
