"""Trained and searching operators: held-out accuracy, planted cases, brute force, public encoders."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from textwarden.llm import decontamination, language_id, token_counts, toxicity

SYLLABLES = {"aa": "ka to mi re su", "bb": "schl ung ach tz er", "cc": "eau oi que ç é"}


def speech(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 40)), lang) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy(tongues):
    model = language_id.fit(tongues.where("doc_id % 3 <> 0"), per_lang=50)
    got = language_id.predict(tongues.where("doc_id % 3 = 0"), model, extra={"truth": F.col("lang")}).collect()
    assert np.mean([r.truth == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_odd(tongues, odd, odd_rows, nothing):
    model = language_id.fit(tongues)
    got = {(r.doc_id, r.n_chars): r for r in language_id.predict(odd, model, extra={"n_chars": F.col("n_chars")}).collect()}
    for r in odd_rows:
        letters = any(c.isalpha() for c in r[1] or "")
        p = got[(r[0], r[4])]
        assert (p.lang_pred in SYLLABLES) == letters and (letters or (p.lang_pred == "und" and p.score == 0.0))
    assert language_id.predict(nothing, model).count() == 0
    assert language_id.fit(nothing) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8, 20])
def test_codewords(k):
    c = language_id.codewords(k)
    assert len(c) == k and len({tuple(r) for r in c.tolist()}) == k
    if k == 7:
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) == 32  # half of the bits


def test_one_language(tongues):
    m = language_id.fit(tongues.where("lang = 'aa'"))
    assert {r.lang_pred for r in language_id.predict(tongues.limit(20), m).collect()} == {"aa"}


def test_language_of_long_texts_only(spark, tongues):
    """A language whose texts are all above the bound, or all repeats of one row, is learnt too."""
    rng = random.Random(8)
    long = spark.createDataFrame([(1000 + i, "1234 " * 5000 + speech(rng, "cc", 3000), "cc") for i in range(6)], "doc_id long, text string, lang string")
    same = spark.createDataFrame([(2000, speech(random.Random(1), "bb", 60), "bb")] * 400, "doc_id long, text string, lang string")
    model = language_id.fit(tongues.where("lang = 'aa'").union(long).union(same), per_lang=8)
    assert model.langs == ("aa", "bb", "cc")
    got = language_id.predict(long, model).collect()
    assert {r.lang_pred for r in got} == {"cc"}


def test_primal_equals_dual(tongues):
    """The solver for many rows gives the weights of the one for few."""
    a, b = language_id.fit(tongues, per_lang=40), language_id.fit(tongues, per_lang=40, dual=0)
    assert np.abs(a.weights - b.weights).max() < 1e-3 * np.abs(a.weights).max() and np.allclose(a.trust, b.trust)


def test_pieces_of_long_texts():
    t = ("köln und é " * 60_000).encode()
    assert len(t) > 2 * language_id.PIECE
    whole = np.zeros(1 << language_id.BITS)
    b = language_id._FOLD[np.frombuffer(t, np.uint8)]
    for k in language_id.ORDERS:
        key = np.zeros(len(b) - k + 1, np.uint64)
        for j in range(k):
            key = (key << np.uint64(8)) | b[j : len(b) - k + 1 + j]
        h = ((key + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - language_id.BITS)
        whole += np.bincount(h.astype(np.int64), minlength=1 << language_id.BITS)
    v = np.sqrt(whole)
    assert np.allclose(language_id.vector(t), v / np.linalg.norm(v), atol=1e-5)
    place, slot = toxicity.words(np.frombuffer(t, np.uint8))
    assert len(place) == 180_000 and len(set(slot.tolist())) == 3


@pytest.fixture(scope="module")
def bags(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        sents = [speech(rng, "aa", rng.randint(4, 9)) for _ in range(rng.randint(1, 8))]
        if bad:
            sents[rng.randrange(len(sents))] += f" {rng.choice(['Vile', 'gross'])} {speech(rng, 'aa', 2)}"
        docs.append((i, ". ".join(sents) + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (999, 1), (None, 1)], "doc_id long, toxic int"), dict(labels)


def test_toxicity(bags):
    docs, labels, truth = bags
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 2"))
    hits = []
    for r in toxicity.score(docs, model).collect():
        if r.doc_id % 4 == 2:
            hits.append((r.toxic_score >= toxicity.THRESHOLD) == (truth[r.doc_id] == 1))
        if truth[r.doc_id] and r.doc_id % 4 == 2:
            found = [r.text.encode()[s.start : s.end].decode().lower() for s in r.offending]
            assert len(found) == 1 and ("vile" in found[0] or "gross" in found[0])
    assert np.mean(hits) > 0.97


def test_toxicity_odd(bags, odd, odd_rows, nothing):
    docs, labels, _ = bags
    model = toxicity.fit(docs, labels)
    out = toxicity.score(odd, model)
    assert len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert len(got) == len(odd_rows) and all(0 <= r.toxic_score <= 1 for r in got)
    assert all(r.toxic_score == 0 and r.n_sentences == 0 for r in got if not r.text)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert all(r.toxic_score < 1e-9 for r in toxicity.score(docs.limit(5), None).collect())


def test_noisy_or_by_hand(bags, spark):
    """Document scores are 1 - prod(1 - p) of sentences scored one by one, and the weights that training leaves explain the labels."""
    docs, labels, truth = bags
    w, bias = toxicity.fit(docs, labels)
    for r in toxicity.score(docs.where("doc_id < 40"), (w, bias)).collect():
        left, raw = 1.0, r.text.encode()
        starts = toxicity.sentence_starts(np.frombuffer(raw, np.uint8)).tolist()
        for a, b in zip(starts, [*starts[1:], len(raw)], strict=True):
            _, slot = toxicity.words(np.frombuffer(raw[a:b], np.uint8))
            left *= 1 - 1 / (1 + np.exp(-(bias + sum(float(w[s]) for s in slot))))
        assert r.toxic_score == pytest.approx(1 - left, abs=1e-4) and r.n_sentences == len(starts)


def test_loss_weighted_decoding_by_hand():
    """The language of least weighted loss, its softmax score and the gap, one row and bit at a time."""
    rng = np.random.default_rng(4)
    codes = language_id.codewords(5)
    m = language_id.Model(tuple("abcde"), codes, rng.normal(size=(30, codes.shape[1])).astype(np.float32), rng.dirichlet(np.ones(codes.shape[1]), 5).astype(np.float32))
    x = rng.normal(size=(40, 30)).astype(np.float32)
    best, p, gap = language_id.decode(m, x)
    for i in range(len(x)):
        loss = [sum(m.trust[k, j] * np.exp(-max(-2, min(2, float(x[i] @ m.weights[:, j]))) * codes[k, j]) for j in range(codes.shape[1])) for k in range(5)]
        order = np.argsort(loss)
        assert best[i] == order[0] and gap[i] == pytest.approx(loss[order[1]] - loss[order[0]], abs=1e-3)
        assert p[i] == pytest.approx(1 / sum(np.exp(-4 * (v - min(loss))) for v in loss), rel=1e-2)


def test_many_languages(spark):
    """No language is left out, however many there are; with many, fewer texts of each are learnt from."""
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices(f"{chr(97 + i % 26)}{chr(97 + i % 80 // 4)}xyz", k=5)) for _ in range(20)), f"l{i % 80:02}") for i in range(800)]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=400)
    assert len(m.langs) == 80


def test_fold():
    t = "ÀÉÞ×ß AZaz Ñ"
    assert toxicity.fold(np.frombuffer(t.encode(), np.uint8)).tobytes().decode() == "àéþ×ß azaz ñ"


@pytest.fixture(scope="module")
def search(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(14, 45)))) for i in range(40)]
    docs, truth = [], []
    for i in range(240):
        ws = rng.choices(vocab, k=rng.randint(40, 160))
        kind, hit = i % 6, None
        if kind < 4:
            item, text = rng.choice(items)
            p = text.split()
            edits = rng.randint(0, int(0.2 * len(p))) if kind else 0
            for _ in range(edits):
                p[rng.randrange(len(p))] = rng.choice(vocab)
            at = rng.randrange(len(ws))
            ws[at:at] = p
            hit = item
        docs.append((i, " ".join(ws)))
        truth.append((i, hit))
    return docs, items, truth


def test_decontamination_recall_and_exactness(spark, search):
    docs, items, truth = search
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r.doc_id: set(r.item_ids) for r in decontamination.summary(decontamination.find(d, spark.createDataFrame(items, "item_id long, text string"))).collect()}
    planted = [(i, h) for i, h in truth if h is not None]
    assert sum(h in found[i] for i, h in planted) / len(planted) >= 0.9
    words = {i: t.split() for i, t in items}
    for i, t in docs:  # what is reported is right, by brute force over all windows
        ws = t.split()
        for item in found[i]:
            p = words[item]
            assert contaminated(ws, p)


def contaminated(ws, item):
    """Whether some window of an item's length, at most that many words over an end, is near the item."""
    most = int(0.2 * len(item) + 1e-9)
    return any(brute.edit(ws[max(0, k) : max(0, k + len(item))], item) <= most for k in range(-most, len(ws)))


def test_edit_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (200, 15)), rng.integers(0, 4, (200, 15))
    b[:100] = a[:100]
    b[np.arange(100), rng.integers(0, 15, 100)] = 9
    for most in (0, 2, 6, 15):
        d = decontamination.edit_distances(a, b, most)
        for i in range(200):
            e = brute.edit(a[i].tolist(), b[i].tolist())
            assert (d[i] == e) if e <= most else (d[i] > most)


def test_decontamination_odd(spark, odd, odd_rows, nothing, monkeypatch):
    text = next(r[1] for r in odd_rows if r[0] == 10)
    part = " ".join(text.split()[20:50])
    items = spark.createDataFrame([(1, part), (2, None), (3, ""), (None, part), (4, part), (5, "one")], "item_id long, text string")
    out = decontamination.find(odd, items)
    assert len(out.columns) == len(set(out.columns))
    got = decontamination.summary(out).collect()
    assert len(got) == len(odd_rows)
    want = sorted((r[0] if r[0] is not None else -1) for r in odd_rows if contaminated(decontamination.words(r[1]), decontamination.words(part)))
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got if {1, 4} <= set(r.item_ids)) == want
    assert all(5 in r.item_ids for r in got if r.doc_id in (3, 4, 5))
    assert decontamination.find(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontamination.summary(decontamination.find(odd, items.limit(0))).collect())
    named = decontamination.summary(decontamination.find(odd, items.selectExpr("concat('i', item_id) AS item_id", "text"))).collect()
    assert sorted(sum((r.item_ids for r in named), [])) == sorted(f"i{x}" for r in got for x in r.item_ids)
    monkeypatch.setattr(decontamination, "CHUNK_WORDS", 1)  # a pass for each item
    again = decontamination.summary(decontamination.find(odd, items)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_very_long_document(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 64)
    assert decontamination.tables_for(0.97, 0.5, 2) == 13
    assert decontamination.words("A-b c_d É1!") == ["a", "b", "c_d", "é1"]


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the tokenizer file")
def test_counts_match_public_encoder(spark, odd, odd_rows):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    usual = lambda i: not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
    tk = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i) if usual(i) else -1e9) for i in range(sp.get_piece_size())], 0, True))
    tk.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = [r.n_tokens for r in sorted(token_counts.count_tokens(odd, token_counts.load_sentencepiece(MODEL)).collect(), key=lambda r: (str(r.doc_id), str(r.text)))]
    rows = sorted(odd_rows, key=lambda r: (str(r[0]), str(r[1])))
    assert got == [len(tk.encode(r[1]).ids) if r[1] else 0 for r in rows]


@pytest.mark.parametrize("seed", range(25))
def test_counts_brute(seed):
    """Against every segmentation, with ties, unknown characters and pieces across spaces."""
    from tokenizers import Tokenizer, models

    rng = random.Random(seed)
    letters = "abc" + ("▁" if seed % 2 else "")
    scores = {c: -1.0 * rng.randint(1, 3) for c in letters[: rng.randint(1, len(letters))]}
    for _ in range(rng.randint(0, 8)):
        scores["".join(rng.choices(letters, k=rng.randint(2, 4)))] = -1.0 * rng.randint(1, 5)
    v = token_counts.Vocabulary(scores, byte_fallback=False, dummy_prefix=False)
    tk = Tokenizer(models.Unigram([("<unk>", min(scores.values())), *scores.items()], 0, False))
    for _ in range(40):
        t = "".join(rng.choices(letters + "dé", k=rng.randint(1, 14)))
        assert v.count(t) == len(tk.encode(t).ids), (scores, t)


def test_counts_remember_in_bounds(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBER", 5)
    v = token_counts.Vocabulary({"a": -1.0, "b": -1.0, "▁": -1.0, "ab": -1.5})
    texts = [" ".join("ab"[: i % 2 + 1] * (j + 1) for j in range(9)) for i in range(9)]
    first = [v.count(t) for t in texts]
    assert first == [v.count(t) for t in texts] and len(v._new) <= 5 and len(v._old) <= 5


def test_counts_empty(nothing):
    v = token_counts.Vocabulary({"a": -1.0})
    assert token_counts.count_tokens(nothing, v).count() == 0 and v.count("") == v.count(None) == 0
