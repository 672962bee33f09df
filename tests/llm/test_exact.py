"""Operators with one right answer against brute force on odd rows and random tables."""

import hashlib
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from textwarden.llm import blocks as B
from textwarden.llm import jaccard_join, lm_scoring, mixing, quality, substring_dedup, suffix_dedup
from textwarden.llm.hashing import Rolling, mix, sliding_min


def key(x):
    return repr(x)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


def substring_want(rows, width):
    ws = [[w.encode() for w in brute.words(r[1])] for r in rows]
    return [(r[0], len(w), sum(m), brute.kept_digest(w, m, b" ")) for r, w, m in zip(rows, ws, brute.repeated(ws, width), strict=True)]


def suffix_want(rows, width):
    bs = [(r[1] or "").encode() for r in rows]
    out = []
    for r, b, m in zip(rows, bs, brute.repeated(bs, width), strict=True):
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        spans = sum(y and not x for x, y in zip([False, *m], m, strict=False))
        out.append((r[0], len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_odd(odd, odd_rows):
    got = [tuple(r) for r in substring_dedup.remove_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = substring_want(odd_rows, 35)
    same(got, want)
    assert sum(w[2] for w in want) > 300


def test_suffix_odd(odd, odd_rows):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = [tuple(r) for r in suffix_dedup.remove_repeats(odd, width=150).select(*cols).collect()]
    want = suffix_want(odd_rows, 150)
    same(got, want)
    assert any(w[2] for w in want)


def test_spans_rebuild_text(odd):
    for r in substring_dedup.remove_repeats(odd, carry="n_chars").collect():
        ws = (r.text or "").encode().split()
        gone = {i for s in r.spans for i in range(s.start, s.end)}
        assert b" ".join(w for i, w in enumerate(ws) if i not in gone).decode() == r.kept and len(gone) == r.n_removed
    for r in suffix_dedup.remove_repeats(odd, width=150).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_order(seed):
    """The suffix array of random texts over small alphabets, runs and separators included."""
    rng = np.random.default_rng(seed)
    text = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(2, 200)).astype(np.uint8) + 1
    if seed % 3 == 0:
        text = np.repeat(text, rng.integers(1, 9, len(text))).astype(np.uint8)
    raw = text.tobytes()
    order = suffix_dedup.suffix_order(text, len(text)).tolist()
    assert order == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("match", [substring_dedup.match, suffix_dedup.match])
def test_matchers(match, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, 8)
    body = rng.integers(0, 2, lengths.sum()).astype(np.uint8)
    width = int(rng.integers(1, 12))
    parts = [tuple(x.tolist()) for x in np.split(body, np.cumsum(lengths)[:-1])]
    seen = {}
    for p in parts:
        for i in range(len(p) - width + 1):
            seen[p[i : i + width]] = seen.get(p[i : i + width], 0) + 1
    want = [i + width <= len(p) and seen[p[i : i + width]] > 1 for p in parts for i in range(len(p))]
    assert match(body, lengths, width).tolist() == want


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    assert [sliding_min(x, w).tolist() for w in (1, 7, 50, 51)] == [[min(x[i : i + w]) for i in range(50 - w + 1)] for w in (1, 7, 50, 51)]
    r = Rolling(x)
    assert r.windows(5)[3] == r.of(np.array([3]), np.array([8]))[0]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_odd(odd, odd_rows, n, percent):
    got = [tuple(r) for r in jaccard_join.components(odd, n, percent).select("doc_id", "n_shingles", "component_id").collect()]
    want = [(r[0], *w) for r, w in zip(odd_rows, brute.components([r[:2] for r in odd_rows], n, percent), strict=True)]
    want = [(i, k, i if k == 0 else c) for i, k, c in want]
    same(got, want)


def test_components_chain_and_hubs(spark):
    """Chains that link step by step, families around a shared passage that don't link, copies of several texts."""
    rng = random.Random(4)
    docs, text = [], [f"w{i}" for i in range(90)]
    for i in range(25):  # each step changes two words near the end of what is left
        docs.append((len(docs), " ".join(text)))
        text[3 * i % 90] = f"c{i}"
    common = [f"p{i}" for i in range(70)]
    for i in range(40):
        docs.append((len(docs), " ".join(common + [f"u{i}_{rng.random()}" for _ in range(rng.choice([4, 12, 20, 30]))])))
    docs += [(len(docs) + i, docs[i * 2][1]) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute.components(docs, 4, 85), strict=True)}


@pytest.mark.parametrize("percent", [80, 85, 97])
@pytest.mark.parametrize("seed", range(12))
def test_linked_sets_share_a_signature(seed, percent):
    """Whatever the sizes and wherever the differences lie, also where signatures are ordered by rarity."""
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(0, 1 << 62, int(n)).astype(np.uint64)
    sets = []
    for _ in range(40):
        a = np.unique(draw(rng.integers(1, 400)))
        gone = rng.integers(0, len(a) * (100 - percent) // 100 + 1)
        more = rng.integers(0, max(1, (100 * (len(a) - gone)) // percent - len(a) + 1))
        sets += [a, np.unique(np.concatenate((rng.permutation(a)[gone:], draw(more))))]
    h, count = np.concatenate(sets), np.array([len(x) for x in sets])
    _, place, times = np.unique(h, return_inverse=True, return_counts=True)
    linked = 0
    for sig, of in (jaccard_join.signatures(h, count, percent), jaccard_join.signatures(h, count, percent, sub=2, spare=1.0, rarity=times[place])):
        for x in range(0, len(sets), 2):
            both = len(np.intersect1d(sets[x], sets[x + 1]))
            if both < max(count[x], count[x + 1]) and 100 * both >= percent * (count[x] + count[x + 1] - both):
                linked += 1
                assert np.intersect1d(sig[of == x], sig[of == x + 1]).size
    assert linked > 20


def test_unit_links_join_what_links():
    rng = random.Random(2)
    base = [rng.sample(range(10**6), 40) for _ in range(6)]
    sets = [np.array(sorted(set(b[:k] + rng.sample(range(10**6), rng.randint(0, 5)))), np.uint64) for b in base for k in (40, 38, 36, 20)]
    node, comp = np.arange(len(sets)), np.arange(len(sets))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in jaccard_join.unit_links(node, comp, sets, 85):
        root[find(x)] = find(y)
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                assert find(i) == find(j)


def test_backoff_odd(odd, odd_rows):
    got = lm_scoring.score(odd).collect()
    want = brute.backoff_scores([r[1] for r in odd_rows], 3, 0.4, 2)
    same([(r.doc_id, r.n_words, round(r.log_score, 6)) for r in got], [(r[0], len(brute.words(r[1])), round(w, 6)) for r, w in zip(odd_rows, want, strict=True)])


def test_mixing_odd(odd, odd_rows):
    got = mixing.plan(odd).collect()
    sizes = {}
    for r in odd_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = brute.targets(sizes)
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size)
        rate = r.target / r.source_size
        assert r.size == 0 or int(rate) <= r.copies <= int(rate) + 1
    again = sorted(tuple(r) for r in mixing.plan(odd.repartition(5)).select("size", "taken").collect())
    assert again == sorted((r.size, r.taken) for r in got)
    out = mixing.emit(odd)
    assert out.count() == sum(r.copies for r in got) and out.columns.count("copy") == 1


def test_mixing_comes_near_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 7 AS int))").alias("text"), F.expr("concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 8 END)").alias("source"))
    for r in mixing.plan(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect():
        assert abs(r.k - r.t) < 0.1 * r.t


def test_quality_odd(odd, odd_rows):
    got = quality.score(odd).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r[0], *brute.quality_counts(r[1])) for r in odd_rows]
    same([(r.doc_id, *(r[c] for c in cols)) for r in got], want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


@pytest.mark.parametrize("seed", range(12))
def test_greedy_factors(seed):
    """Step by step: each factor is the longest stretch that also starts elsewhere and ends in its segment, the next begins at its end."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 30, 6)
    body = rng.integers(0, rng.integers(2, 9), lengths.sum()).astype(np.uint32)
    ends = np.repeat(np.cumsum(lengths), lengths)
    size, source = substring_dedup.longest_matches(body, lengths)

    def longest(i):
        def run(j):
            k = 0
            while i + k < ends[i] and j + k < ends[j] and body[i + k] == body[j + k]:
                k += 1
            return k

        return max((run(j) for j in range(len(body)) if j != i), default=0)

    assert size.tolist() == [longest(i) for i in range(len(body))]
    for i, (n, j) in enumerate(zip(size, source, strict=True)):
        assert (j == -1) if n == 0 else (j != i and (body[i : i + n] == body[j : j + n]).all() and j + n <= ends[j])
    want, at = [], 0
    for n in lengths:
        end = at + n
        while at < end:
            want.append(at)
            at += max(1, longest(at))
        at = end
    assert substring_dedup.factors(size, lengths).tolist() == want


@pytest.mark.parametrize("word", ["7" * 1_200_000, "!#?" * 400_000, "é" * 1_000_000])
def test_quality_of_one_long_word(spark, word):
    """Time is linear in a word's length, whatever it holds."""
    r = quality.features(spark.createDataFrame([(1, f"a {word} b")], "doc_id long, text string")).first()
    assert (r.n_words, r.n_letter_words, r.word_chars) == (3, 2 + word[0].isalpha(), len(word) + 2)


def test_quality_em(spark):
    """The expectation-maximisation against the same steps in plain Python."""
    import math

    rng = random.Random(3)
    rows = []
    for i in range(400):
        bad = i % 10 == 0
        rows.append((i, [rng.choice([-1, -1, 0, 1]) if bad else rng.choice([1, 1, 1, 1, 0, -1]) for _ in quality.RULES]))
    m = quality.estimate(spark.createDataFrame(rows, "doc_id long, votes array<int>"), 25).first()
    prior, acc = quality.PRIOR, [(quality.ON_GOOD, quality.ON_BAD)] * len(quality.RULES)
    for _ in range(25):
        post = []
        for _, v in rows:
            z = math.log(prior / (1 - prior))
            for x, (a, b) in zip(v, acc, strict=True):
                z += {1: math.log(a / (1 - b)), -1: math.log((1 - a) / b), 0: 0}[x]
            post.append(1 / (1 + math.exp(-z)))
        prior = min(0.99, max(0.01, (quality.PRIOR + sum(post)) / (len(rows) + 1)))
        new = []
        for k in range(len(acc)):
            ag = (quality.ON_GOOD + sum(p for p, (_, v) in zip(post, rows, strict=True) if v[k] == 1)) / (1 + sum(p for p, (_, v) in zip(post, rows, strict=True) if v[k]))
            bb = (quality.ON_BAD + sum(1 - p for p, (_, v) in zip(post, rows, strict=True) if v[k] == -1)) / (1 + sum(1 - p for p, (_, v) in zip(post, rows, strict=True) if v[k]))
            new.append((min(0.999, max(0.05, ag)), min(0.999, max(0.05, bb))))
        acc = new
    assert m.prior == pytest.approx(prior) and [(c.a, c.b) for c in m.acc] == [(pytest.approx(a), pytest.approx(b)) for a, b in acc]


@pytest.mark.parametrize("blocks,buckets", [(40, 2049), (5000, 9000), (3, 70_000)])
def test_two_step_counts(spark, blocks, buckets):
    """Counts are the same in one step and two, and no task makes more slices than the square roots allow."""
    rng = np.random.default_rng(blocks)
    rows = [(int(i), rng.choice(400, 60).astype(np.int64).tolist()) for i in rng.choice(blocks, 12)]
    df = spark.createDataFrame(rows, "block int, tokens array<long>")

    def grams(table):
        flat = [x for v in table["tokens"].to_pylist() for x in v]
        return mix(np.array(flat, np.uint64))

    lay = B.Layout(blocks, buckets)
    supers, coarse, fine = lay.steps
    assert supers and coarse * fine >= buckets and max(coarse, fine, supers) <= 2 + 1.01 * max(buckets, blocks) ** 0.5
    back = B.corpus_counts(df, lay, grams).toArrow()
    total = {}
    for _, ts in rows:
        for x in ts:
            total[x] = total.get(x, 0) + 1
    for block in {b for b, _ in rows}:
        own = np.array(sorted({x for b, ts in rows for x in ts if b == block}), np.uint64)
        order = np.argsort(mix(own))
        mine = back.filter(pc.equal(back["block"], block))
        assert len(mine) <= coarse
        assert B.block_counts(mix(own)[order], mine).tolist() == [total[x] for x in own[order].tolist()]


def test_two_step_signatures(spark, monkeypatch):
    """Components are the same when signatures go by coarse ranges."""
    rng = random.Random(12)
    docs = []
    for i in range(60):
        ws = [f"w{rng.randrange(500)}" for _ in range(50)] if i % 3 == 0 else ws[:-1] + [f"x{i}"]
        docs.append((i, " ".join(ws)))
    monkeypatch.setattr(B, "FAN", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute.components(docs, 4, 85), strict=True)}


def test_very_long_text(spark):
    """Texts of more than a million characters are taken whole."""
    rng = random.Random(13)
    vocab = [f"wörd{i}" for i in range(3000)]
    drawn = rng.choices(vocab, k=130_000)
    long, half = " ".join(drawn), " ".join(drawn[:60_000])
    assert len(long) > 1_000_000
    rows = [(1, long, "a"), (2, "first " + half, "a"), (3, long + " last", "b"), (4, "short text", None), (5, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {1: "", 2: "first", 3: "last", 4: "short text", 5: ""}
    for r in substring_dedup.remove_repeats(docs).collect():
        assert r.kept == kept[r.doc_id] and r.n_removed == r.n_words - len(r.kept.split())
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert r.kept.decode().strip() == kept[r.doc_id] and r.n_spans == (r.doc_id < 4) and r.n_removed + len(r.kept) == r.n_bytes
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    ws = {i: (t or "").split() for i, t, _ in rows}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()) for i, w in ws.items()}
    assert got == {i: (len(sets[i]), 1 if i == 3 else i) for i in sets}
    size = {r.doc_id: r["size"] for r in mixing.plan(docs).collect()}
    assert size == {i: len(w) for i, w in ws.items()}
    assert {r.doc_id: r.n_words for r in lm_scoring.score(docs).collect()} == size
    base = {r.doc_id: r for r in quality.score(docs).collect()}
    assert {i: r.n_words for i, r in base.items()} == size and base[1].word_chars == len(long.replace(" ", ""))
    three = [tuple(ws[1][k : k + 3]) for k in range(len(ws[1]) - 2)]
    times = {}
    for t in three:
        times[t] = times.get(t, 0) + 1
    assert base[1].n_repeat_words == len({k + j for k, t in enumerate(three) if times[t] > 1 for j in range(3)})


def test_empty_tables(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert jaccard_join.components(nothing).count() == 0
    assert lm_scoring.score(nothing).count() == 0
    assert mixing.plan(nothing).count() == 0 and mixing.emit(nothing).count() == 0
    assert quality.score(nothing).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_looked_up(spark, monkeypatch, hot):
    """Frequent keys, rare keys, keys that the table lacks and null keys keep all their rows."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    keys = [1] * 50 + [2] * 5 + list(range(3, 30)) + [None] * 20
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k long")
    table = spark.createDataFrame([(k, f"v{k}", keys.count(k)) for k in set(keys) - {None, 7}], "k long, v string, n long")
    got = {(r.id, r.k, r.v) for r in jaccard_join.looked_up(rows, table, "k", "n").collect()}
    assert got == {(i, k, None if k in (None, 7) else f"v{k}") for i, k in enumerate(keys)}
    none = table.limit(0)
    assert jaccard_join.looked_up(rows, none, "k", "n").where("v IS NULL").count() == len(keys)


def test_large_families(spark, monkeypatch):
    """The path of families that don't fit into a task, forced by a small unit."""
    monkeypatch.setattr(jaccard_join, "UNIT", 6)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    docs = []
    for i in range(45):
        ws = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            ws[rng.randrange(80)] = f"x{rng.random()}"
        docs.append((i, " ".join(ws)))
    docs += [(45 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(6 + i)])) for i in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute.components(docs, 4, 85), strict=True)}


def test_family_of_many_chunks(spark, monkeypatch):
    """A family far larger than a unit, of texts around one passage, some of them near copies: the result is exact, and a set
    is copied only to chunks that hold a set with which it shares rare n-grams."""
    monkeypatch.setattr(jaccard_join, "UNIT", 8)
    seen = []
    whole = jaccard_join.units

    def noted(*tables):
        out = whole(*tables)
        seen.extend(r.n for r in out.groupBy("node").agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(jaccard_join, "units", noted)
    rng = random.Random(3)
    common = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(160):
        own = [f"u{i // 2}_{j}" for j in range(rng.choice([18, 25, 32]) if i % 2 == 0 else len(own))]
        own[-1] = f"last{i}"
        docs.append((i, " ".join(common + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute.components(docs, 4, 85), strict=True)}
    assert len({c for _, c in got.values()}) <= 80
    assert 0 < max(seen) <= 4


@pytest.mark.parametrize("seed", range(4))
def test_contract(spark, seed):
    """Chains, stars and random links come to one name each, whatever the order of the ids."""
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    got = {r.node: r.comp for r in jaccard_join._contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == ends
    assert len({(find(x), got[x]) for x in ends}) == len({find(x) for x in ends}) == len({got[x] for x in ends})


@pytest.mark.parametrize("seed", range(10))
def test_roots(seed):
    rng = random.Random(seed)
    groups = [rng.sample(range(40), rng.randint(2, 4)) for _ in range(rng.randint(0, 14))]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g in groups:
        for x in g[1:]:
            a, b = find(g[0]), find(x)
            root[max(a, b)] = min(a, b)
    flat = np.array([x for g in groups for x in g], np.int64)
    assert jaccard_join.roots(flat, np.array([len(g) for g in groups], np.int64)).tolist() == [find(x) for x in flat.tolist()]
