"""Periodic runs, exact copies and the price join against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tests.llm import brute

from textwarden.llm import band_join, exact_dedup, periodic_runs


def runs_want(s, times=4, least=6):
    """(start, length, period) of all runs of a list, by definition."""
    found = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((a, n, p) for (a, n), p in found.items())


def runs_got(seqs, times=4, least=6):
    first = np.cumsum([0, *map(len, seqs)])
    s = np.array([x for q in seqs for x in q], np.uint64)
    out = [[] for _ in seqs]
    for t, a, n, p in zip(*(c.tolist() for c in periodic_runs.runs(s, first, times, least)), strict=True):
        out[t].append((a, n, p))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs(seed):
    """Random texts over small alphabets, with planted repeats, side by side."""
    rng = random.Random(seed)
    seqs = []
    for _ in range(12):
        q = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 7, 20]))]
            q += (unit * rng.randint(1, 9))[: rng.randint(0, 120)]
        seqs.append(q)
    assert runs_got(seqs) == [runs_want(q) for q in seqs]
    assert runs_got(seqs, 3, 11) == [runs_want(q, 3, 11) for q in seqs]


def test_runs_of_one_long_text():
    rng = random.Random(1)
    noise = [rng.randrange(10**6) for _ in range(30_000)]
    q = noise[:9000] + noise[9000:13_000] * 4 + noise[13_000:] + [7] * 5000
    assert (9000, 16_000, 4000) in runs_got([[], q, [1]])[1] and runs_got([q])[0][-1] == (len(q) - 5000, 5000, 1)


@pytest.mark.parametrize("seed", range(10))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    s = np.append(rng.integers(0, 2, 300) if seed % 2 else np.tile(rng.integers(0, 3, 7), 40), 9)
    i, j = rng.integers(0, len(s), 400), rng.integers(0, len(s), 400)
    i, j = i[i != j], j[i != j]
    want = [next(k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]) for a, b in zip(i, j, strict=True)]
    assert periodic_runs.Extensions(s).of(i, j).tolist() == want


def runs_row(doc_id, text):
    ws = brute.words(text)
    found = runs_want(ws)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    top = min(((-n, a, p) for a, n, p in found), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{n},{p}\n" for a, n, p in found), " ".join(w for i, w in enumerate(ws) if i not in gone))]
    return (doc_id, len(ws), len(found), *best, *digest)


def test_runs_odd(odd, odd_rows):
    rows = [*odd_rows, (90, "a b " * 30, None, None, 1), (91, "x x x x x x y y y y y y", None, None, 1), (None, "k l m " * 5, None, None, 1), (92, "u v w\n" * 20_000, None, None, 1)]
    df = odd.sparkSession.createDataFrame(rows, odd.drop(*odd.columns[5:]).schema).selectExpr("*", "'clash' AS runs", "1 AS n_words", "2 AS h")
    got = [tuple(r) for r in periodic_runs.summary(periodic_runs.find(df)).collect()]
    want = [runs_row(r[0], r[1]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) >= 6


def test_planted_runs(odd, odd_rows):
    def planted(doc_id, text):
        ws = brute.words(text)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not ws:
            return ws
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]

    got = sorted(((r.doc_id, tuple(brute.words(r.text))) for r in periodic_runs.with_planted_runs(odd).collect()), key=repr)
    want = sorted(((r[0], tuple(planted(r[0], r[1]))) for r in odd_rows), key=repr)
    assert got == want and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in odd_rows) > 2


def test_runs_of_nothing(nothing):
    assert periodic_runs.summary(periodic_runs.find(periodic_runs.with_planted_runs(nothing))).collect() == []


def copies_want(rows):
    groups = {}
    for r in rows:
        t = r[1] or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\v\f\r"), []).append((-len(t), r[0] is None, r[0] or 0, r[0]))
    out = []
    for t, of in groups.items():
        best = min(of)
        for x in of:
            out.append((x[3], best[3], len(of), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_copies_odd(odd, odd_rows, counters):
    """With few counters most groups take the shuffle, with many none does."""
    got = exact_dedup.groups(odd, counters=counters).collect()
    want = copies_want(odd_rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.distinct(odd, counters=counters)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


def test_frequent_digests(spark):
    """Each digest above the share is a candidate, however the rows are dealt, and no more candidates than counters."""
    rng = random.Random(3)
    texts = ["hot"] * 300 + ["warm"] * 80 + [f"text {i}" for i in range(900)]
    rng.shuffle(texts)
    told = exact_dedup.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    found = {r.text_sha256 for r in exact_dedup.frequent(told, 20).collect()}
    assert {hashlib.sha256(x).hexdigest() for x in (b"hot", b"warm")} <= found and len(found) <= 20
    sizes = {r.text_sha256: r.group_size for r in exact_dedup.winners(told, exact_dedup.frequent(told, 20)).collect()}
    assert sizes[hashlib.sha256(b"hot").hexdigest()] == 300


def test_copies_of_nothing(nothing):
    assert exact_dedup.groups(nothing).collect() == [] and exact_dedup.distinct(nothing).collect() == []


def cents(x):
    return None if x is None or not abs(100 * x) <= 9e14 else int(np.floor(100 * x + 0.5))


def band_want(items, lines, near=10, per=2):
    told = []
    for sale, no, item, q, amount in lines:
        a = cents(amount)
        if None not in (sale, item, q, a) and q:
            told.append(((2 * a + q) // (2 * q), sale, no, item, zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())))
    out = []
    for item, price in items:
        p, found = cents(price), []
        for u, sale, no, other, crc in told if p is not None and item is not None else ():
            gap = abs(u - p)
            if other != item and (gap <= near or 1000 * gap <= per * p):
                found.append((gap, u, sale, -1 if no is None else no, other, crc))
        found.sort()
        sums = (len(found), sum(x[0] for x in found), sum(x[5] for x in found))
        for k, x in enumerate(found[:5], 1):
            out.append((item, k, *x[:3], None if x[3] < 0 else x[3], x[4], *sums))
        if not found:
            out.append((item, 0, *[None] * 5, 0, 0, 0))
    return out


ITEMS, LINES = "item_id long, price double", "sale_id long, line_no int, item_id long, quantity int, amount double"


def band_got(spark, items, lines, **more):
    i = spark.createDataFrame(items, ITEMS).selectExpr("*", "'clash' AS p", "'clash' AS bucket", "1 AS gap")
    ln = spark.createDataFrame(lines, LINES).selectExpr("*", "'clash' AS u", "'clash' AS salt", "1 AS crc")
    return [tuple(r) for r in band_join.ranked(band_join.near_lines(i, ln, **more)).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_band_join(spark, seed):
    """Random prices, with one item that has most lines; a load of 8 salts nearly every bucket."""
    rng = random.Random(seed)
    items = [(i, rng.choice([3.0, 3.05, round(rng.uniform(2.5, 4), 2), round(rng.uniform(1, 60_000), 2)])) for i in range(25)] + [(3, 3.0), (3, 3.0), (None, 3.0), (40, None), (41, float("nan")), (42, 1e300), (43, -0.03), (44, 8e12)]
    lines = []
    for k in range(260):
        item, q = rng.choice([3, 3, 3, rng.randrange(30)]), rng.randint(1, 9)
        price = rng.choice([3.0, items[item][1] if item < 25 else 5.0, 3.02])
        lines.append((rng.randrange(60), rng.choice([None, 1, 2, 3]), item, q, round(price * q + rng.choice([0, 0, 0.01, -0.02, 0.2]), 2)))
    lines += [lines[0], lines[0], (None, 1, 5, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 5, None, 3.0), (1, 1, 5, 1, None), (1, 1, 5, 0, 3.0), (1, 2, 5, -1, -3.0), (1, 2, 5, 2, -0.05), (1, 1, 5, 1, float("inf")), (9, 9, 9, 1, 8.01e12)]
    want = sorted(band_want(items, lines), key=repr)
    assert sorted(band_got(spark, items, lines), key=repr) == want
    assert sum(w[1] > 0 for w in want) > 60 and any(w[0] == 44 and w[1] for w in want) and any(w[0] == 43 and w[1] for w in want)
    if not seed:
        assert sorted(band_got(spark, items, lines, load=8), key=repr) == want


def test_grid_bounds(spark):
    """However large a price, it is exploded to few buckets, and shares one with every line price near it."""
    prices = spark.createDataFrame([(p,) for p in (1, 300, 40_300, 10**6, 10**9, 10**13)], "p long")
    near = [(p + d, 1, 1, 1) for p in (300, 10**6, 10**13) for d in (-10, 0, 10, p // 500)]
    items, lines = band_join.bucketed(prices, spark.createDataFrame(near, "u long, n long, crc long, apart int"), 10, 2)
    assert max(r["count"] for r in items.groupBy("p").count().collect()) <= band_join.TOUCHED
    met = {(r.p, r.u) for r in items.join(lines, ["level", "bucket", "salt"]).collect()}
    assert {(p, p + d) for p in (300, 10**6, 10**13) for d in (-10, 0, 10, p // 500)} <= met | {(300, 300)}


def test_band_of_nothing(spark):
    assert band_got(spark, [], [(1, 1, 1, 1, 3.0)]) == []
    assert band_got(spark, [(1, 3.0), (None, None)], []) == [(1, 0, *[None] * 5, 0, 0, 0), (None, 0, *[None] * 5, 0, 0, 0)]
