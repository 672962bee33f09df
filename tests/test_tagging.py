"""Tokens and the tagger: exact round trips, windows, Viterbi by enumeration, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.operators import layers, tagger, tokens

ODD = ["", " ", "a", "  two  spaces\n\nlines\t", "é漢字😀 mixed 12ab_cd, and ünïcode²", "\x00\x0b\x0c", "x " * 400, "word " * 300 + "tail", "😀" * 200, "́combining"]


def test_pieces_cover_the_text():
    for t in ODD:
        assert "".join(m.group() for m in tokens._PIECE.finditer(t)) == t
        ids, starts, ends = tokens.encoded(t, {" two": 300, "word": 301})
        assert len(ids) == len(starts) == len(ends) and all(0 <= a < b <= len(t) for a, b in zip(starts, ends, strict=True)) and sorted(starts) == starts


def test_windows_rebuild_and_decode(spark):
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "id int, text string")
    pieces = tokens.vocabulary(df, 20)
    assert len(pieces) == 20 and pieces == tokens.vocabulary(df.repartition(3), 20)
    enc = tokens.encode(df.withColumn("ids", F.lit("clash")), pieces)
    w = tokens.windows(enc, "id", content=30, shared=8, short=0)
    rows = w.collect()
    assert all(len(r.input_ids) == 32 and r.input_ids[0] == tokens.BEFORE and r.input_ids[r.attention - 1] == tokens.AFTER and set(r.input_ids[r.attention :]) <= {tokens.PAD} for r in rows)
    assert all(b.token_start - a.token_start == 22 for a, b in itertools.pairwise(sorted((r for r in rows if r.id == 6), key=lambda r: r.token_start)))
    assert {r.id: r.text for r in tokens.rebuilt(w, "id").collect()} == dict(enumerate(ODD))
    assert {r.id: r.text for r in tokens.decode(enc, pieces, "id").collect()} == {**dict(enumerate(ODD)), 99: ""}
    short = tokens.windows(enc, "id", content=30, shared=8, short=80).where("id = 8").collect()
    assert len(short) == 1 and (short[0].token_end, short[0].char_end) == (30, 200)  # one word, cut off


def test_hits_of_two_windows_come_once(spark):
    text = "one " * 20 + "HIT " + "two " * 20
    enc = tokens.encode(spark.createDataFrame([(1, text)], "id int, text string"), ["one", " one", " two", " HIT"])
    w = tokens.windows(enc, "id", content=24, shared=20, short=0).withColumn("hits", F.expr("transform(filter(sequence(0, size(starts) - 1), i -> ends[i] - starts[i] = 3 AND starts[i] = 80), i -> struct(i AS first, i + 1 AS last, 'c' AS class))"))
    assert w.where("size(hits) > 0").count() > 1
    assert [[tuple(s) for s in r.spans] for r in tokens.spans_of_tokens(w, "id").collect()] == [[(80, 83, "c")]]


@pytest.mark.parametrize("seed", range(12))
def test_viterbi(seed):
    """Against all label sequences, the first of the best by the labels from the last word on."""
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 4))
    m = tagger.Model(tuple("ABC"[:k]), np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    scores = [rng.normal(size=(int(n), k)) for n in rng.integers(0, 6, 9)]
    for s, got in zip(scores, tagger.viterbi(m, scores), strict=True):
        total = lambda y: sum(s[t][y[t]] for t in range(len(s))) + (m.start[y[0]] if len(s) else 0) + sum(m.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(map(total, itertools.product(range(k), repeat=len(s))))
        assert abs(total(got.tolist()) - best) < 1e-9


def test_words_and_sentences():
    t = "Ask j.doe@x.org. Then\nwait 3.5 min! Ok?No"
    at, first = tagger.words(t)
    assert [t[a:b] for a, b in at] == ["Ask", "j.doe@x.org", ".", "Then", "wait", "3.5", "min", "!", "Ok", "?", "No"] and first == [0, 3, 4, 8, 11]
    assert tagger.words("") == ([], [0]) and tagger.shape("Ab-12.") == "Xxodo"


def corpus(rng, n):
    rows = []
    for i in range(n):
        ws, tags = [], []
        for _ in range(rng.randint(2, 6)):
            ws += rng.choices(["the", "report", "and", "a", "meeting"], k=3)
            tags += ["O"] * 3
            kind = rng.randrange(3)
            new, tag = ((["Dr", rng.choice(["Ada", "Ben"]) + rng.choice("xyz"), rng.choice(["Quill", "Moor"])], ["O", "B-NAME", "I-NAME"]), (["room", str(rng.randint(100, 999))], ["O", "B-ROOM"]), (["Dr", "lives"], ["O", "O"]))[kind]
            ws += new
            tags += tag
        rows.append((i, [*ws, "."], [*tags, "O"]))
    return rows


def test_learning(spark):
    """Trained over partitions it tags sentences that it has not seen; the same rows in another order give the same weights."""
    rng = random.Random(4)
    rows = spark.createDataFrame(corpus(rng, 300), "id int, tokens array<string>, tags array<string>")
    m = tagger.fit(rows, rounds=4, bits=12, part_rows=60)
    again = tagger.fit(rows.orderBy(F.desc("id")).repartition(3).union(rows.limit(5)), rounds=4, bits=12, part_rows=60)
    assert (m.emit == again.emit).all() and m.labels == ("O", "B-NAME", "B-ROOM", "I-NAME")
    right = total = 0
    for _, ws, tags in corpus(random.Random(77), 80):
        got = tagger.viterbi(m, [m.scores(ws)])[0]
        right += sum(m.labels[g] == y for g, y in zip(got, tags, strict=True))
        total += len(ws)
    assert right / total > 0.98
    df = spark.createDataFrame([("a report and Dr Adaz Quill. the room 512 and a\nmeeting",), ("",), (None,)], "text string")
    got = layers.tag(df, lambda: tagger.load(m), types={"NAME": "Full Name"}).collect()
    assert [[(e.start, e["end"], e.label, e.type, e.match) for e in r.entities] for r in got] == [[(16, 26, "NAME", "Full Name", "Adaz Quill")], [], []]
    assert layers.tag(df.limit(1), lambda: tagger.load(m), types={"NAME": "n"}, most_chars=20).first().entities[0].match == "Adaz"
    assert tagger.fit(rows.limit(0)) is None


def test_token_rows(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org or call 555-0100 now", [(5, 14, "mail"), (23, 31, "phone"), (23, 26, "part")]), (2, None, None)], "id int, text string, spans array<struct<start:int,end:int,class:string>>")
    rows = {r.id: r for r in tagger.token_rows(df, "id").collect()}
    assert list(zip(rows[1].tokens, rows[1].tags, strict=True)) == [("mail", "O"), ("a.b@c.org", "B-mail"), ("or", "O"), ("call", "O"), ("555-0100", "B-phone"), ("now", "O")]
    assert rows[2].tokens == []


def test_learnt_from_detectors(spark):
    """On documents held out from the fit, tagged mail and network addresses are the detectors' in most cases."""
    kinds = ("email address", "IP address (IPv4)")
    from textwarden.plans import tagger_queries as Q
    from textwarden.plans.common import reader

    t = reader(spark, "/root/testdata/sf0.01")
    m = Q.learnt(t)
    held = Q.silver(t).where("crc32(cast(doc_id AS string)) % 3 = 1")
    rows = layers.tag(held, lambda: tagger.load(m), types={n: n for n in Q.TEACHERS}).collect()
    want = {(r.doc_id, s.start, s["end"]) for r in rows for s in r.spans if s["class"] in kinds}
    got = {(r.doc_id, e.start, e["end"]) for r in rows for e in r.entities if e.label in kinds}
    assert len(want) > 5 and len(want & got) >= 0.7 * len(want) and len(want & got) >= 0.9 * len(got)
