"""The tagger works on many texts at once, as it would word by word; its training reads the rows once."""

import random

import numpy as np
import pytest

from textwarden.functions.patterns import MEDIUM, STRONG
from textwarden.operators import spans, tagger
from textwarden.plans import tagger_queries

ODD = ["", "\n", " a", "x", "A.b. c.d@e-f_g'h' .i\n\nJ", "é漢字😀 12ab_cd, ünï²", "\x00\x0b\x0c!? Yes", "a.. b", "_a_", "3.5.6-", "@x@y@", "٣٤.٥ ⅧK\x1c z", "Go! Now", "Go!Now"]


def plain(m, text):
    """Sentence by sentence, without any word settled beforehand."""
    at, first = tagger.words(text)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        e = m.scores([text[x:y] for x, y in at[a:b]])
        e[0] += m.start
        last = "O"
        for (x, y), k in zip(at[a:b], tagger._paths(e, np.array([0]), m.move), strict=True):
            tag = m.labels[k]
            name = tag[2:] if tag[:2] in ("B-", "I-") else tag
            if name != "O" and name == last and tag[:2] != "B-":
                out[-1] = (out[-1][0], y, name)
            elif name != "O":
                out.append((x, y, name))
            last = name
    return out


def texts(seed, n):
    rng = random.Random(seed)
    return [*ODD, *("".join(rng.choices(["a", "Bc", "12", ".", "@", "-", "'", "_", " ", "\n", "!", "?", "é", "漢", "²", "\t", ", "], k=rng.randrange(60))) for _ in range(n))]


def test_split():
    some = texts(1, 400)
    whole, a, z, new = tagger.split(some)
    got = [(whole[i:j], bool(k)) for i, j, k in zip(a.tolist(), z.tolist(), new, strict=True)]
    want = [(t[x:y], i in set(first[:-1])) for t in some for at, first in [tagger.words(t)] for i, (x, y) in enumerate(at)]
    assert got == want
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    _, a, _, _ = tagger.split(every)
    assert (np.searchsorted(a, np.arange(0, 2 * len(every), 2)) < np.searchsorted(a, np.arange(1, 2 * len(every), 2))).tolist() == [bool(tagger.words(c)[0]) for c in every]


@pytest.mark.parametrize("seed", range(8))
def test_tagging_many_texts(seed):
    """Integer weights with ties, few and many words settled beforehand, numbers of words forgotten on the way."""
    rng = np.random.default_rng(seed)
    labels = ("O", "B-X", "I-X", "Y")[: 2 + seed % 3]
    emit, move = rng.integers(-3, 4, (64, len(labels))).astype(np.float32), rng.integers(-2, 3, (len(labels),) * 2).astype(np.float32)
    emit[:, 0] += seed % 4
    m = tagger.Model(labels, emit, move, rng.integers(-2, 3, len(labels)).astype(np.float32))
    some = texts(seed, 60)
    tag = tagger.load(m)
    assert tag(some) == [plain(m, t) for t in some] == [s for t in some for s in tag([t])]
    assert tag([]) == []


def test_words_of_a_shape():
    some = [*texts(3, 200), "a1B-" * 3 + " " + "a1B-" * 6 + "a1B " + "a1B-" * 7 + "aa " + "a1B-" * 40 + " " + "1a" * 13 + "1" + " " + "1a" * 14, "z" * 300 + "Q" * 300]
    whole, a, z, _ = tagger.split(some)
    like, back = tagger.alike(whole, a, z)
    assert [tagger.shape(like[i]) for i in back] == [tagger.shape(whole[i:j]) for i, j in zip(a.tolist(), z.tolist())]
    assert len(like) < 100 < len(back)
    assert tagger.alike("\n", *(np.zeros(0, np.int64),) * 2)[0] == []
    tag = tagger.load(tagger_queries.FIXED)
    assert tag(some) == [plain(tagger_queries.FIXED, t) for t in some] and sum(map(len, tag(some))) > 100


def test_numbers_of_words_are_bounded():
    seen = tagger.Seen(lambda p, vs: tagger.hashed(p, vs, 64), most=10)
    want = {w: tagger.hashed("w=", [w], 64)[0] for w in map(str, range(40))}
    for some in ("1 2 3", " ".join(map(str, range(12))), "5 6", "30 31 5", "5"):
        assert [seen.rows[i, 1] for i in seen.of(some.split())] == [want[w] for w in some.split()]
        assert len(seen.ids) <= 10 + 12


def test_learning_is_that_of_one_sentence_after_the_other():
    """Against updates after each sentence, decoded by itself."""
    rng = np.random.default_rng(5)
    slots, labels = 256, ("O", "B-A", "I-A")
    words = [[str(rng.choice(["Ada", "x", "12", "the", "a.b", "."])) for _ in range(rng.integers(1, 9))] for _ in range(150)]
    seen = tagger.Seen(lambda p, vs: tagger.hashed(p, vs, slots))
    ids, new = seen.of([w for ws in words for w in ws]), np.concatenate([np.arange(len(ws)) == 0 for ws in words])
    before, after = tagger.neighbours(ids, new)
    keys, back = seen.pair_slots(before, ids)
    part = tagger.Part(seen.rows, seen.wide, ids, before, after, keys[back], rng.integers(0, 3, len(ids)).astype(np.int16), new)
    got, want = (np.zeros((slots + 4, 3), np.float32) for _ in range(2))
    names, first = tagger.slots_of(*part[:6]), [*np.flatnonzero(new).tolist(), len(new)]
    for turn in range(3):
        tagger._learn(part, got[:slots], got[slots:-1], got[-1], turn)
        for i in np.random.default_rng(turn).permutation(len(first) - 1):
            own, truth = names[first[i] : first[i + 1]], part.truth[first[i] : first[i + 1]]
            e = want[own].sum(1).astype(np.float64)
            e[0] += want[-1]
            guess = tagger._paths(e, np.array([0]), want[slots:-1])
            for t, (s, g, y) in enumerate(zip(own, guess, truth, strict=True)):
                if g != y:
                    np.add.at(want, (s, y), 1)
                    np.add.at(want, (s, g), -1)
                if t and (truth[t - 1], y) != (guess[t - 1], g):
                    want[slots + truth[t - 1], y] += 1
                    want[slots + guess[t - 1], g] -= 1
                if not t and g != y:
                    want[-1, y] += 1
                    want[-1, g] -= 1
        assert np.abs(got).sum() > 0 and (got == want).all()


def test_rows_are_made_once(spark):
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    d = spark.range(40).selectExpr("array('mail', concat('a@b', id), '.') AS tokens", "array('O', 'B-m', 'O') AS tags")
    m = tagger.fit(d.mapInArrow(counted, "tokens array<string>, tags array<string>"), rounds=3, bits=8)
    assert m.labels == ("O", "B-m") and n.value == 40


def test_detectors_beyond_ascii(spark):
    """Guards leave out no match where digits or letters are not those of ASCII."""
    some = ["é 1٣.٤٥.6.7 x", "é ٠١٢-٣٤-٥٦٧٨", "é 4111 1111 1111 111１ z", "é a@b.co", "é call 555 123 4567 or (555)-123-4567", "paſſport no A1234567", "é PASSPORT: AB1234567"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "id int, text string")
    got = {r.id: [tuple(s)[:3] for s in r.spans] for r in spans.find_all(d, (*STRONG, *MEDIUM)).collect()}
    bare = spans.find_all(d, tuple(type(p)(p.name, p.regex + "(?:)", p.tier) for p in (*STRONG, *MEDIUM)))  # no guard has this pattern
    assert got == {r.id: [tuple(s)[:3] for s in r.spans] for r in bare.collect()} and sum(map(len, got.values())) > 5
