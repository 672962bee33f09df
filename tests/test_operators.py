"""Spans, remediation, curation, metrics, events, streams and sources on small tables."""

import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textwarden.functions import patterns as P
from textwarden.functions.dialect import SPARK, apply
from textwarden.operators import curate, evaluate, feedback, remediate, scan, spans
from textwarden.operators import events as E
from textwarden.sources import readers, writers
from textwarden.streaming import dedupe, ledger

MAIL = next(p for p in P.STRONG if p.name == "email address")


def test_offsets_match_python(spark):
    texts = ["", "a@b.org", "é😀 a@b.org, x@yy.com é a@b.org", "none", "a@b.orga@b.org"]
    rows = spans.find(spark.createDataFrame([(t,) for t in texts], "text string"), MAIL).collect()
    for r in rows:
        assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer(MAIL.regex, r.text)]


def test_find_all_agrees_with_native(spark):
    df = spark.createDataFrame([("mail a@b.org or 10.0.0.1",), (None,)], "text string")
    got = {r.text: [(s.start, s["end"], s["class"]) for s in r.spans] for r in spans.find_all(df).collect()}
    assert got[None] == [] and (5, 12, "email address") in got["mail a@b.org or 10.0.0.1"]


def test_highlight_and_masks(spark):
    kind = f"text string, spans array<{spans.SPAN}>"
    rows = [("call 415-555-0100 now", [(0, 21, "window", "", "model_window", "med"), (5, 17, "phone number", "415-555-0100", "regex", "high")]), (None, None)]
    df = spark.createDataFrame(rows, kind)
    own = df.withColumn("spans", F.expr("filter(spans, s -> s.source = 'regex')"))
    assert [r.edited for r in spans.edit(df, "highlight").collect()] == ["call [phone number] now", None]
    assert {m: spans.edit(own, m).first().edited[5:-4] for m in ("full", "type_only", "stars", "partial")} == {"full": "[phone number]", "type_only": "[PHONE NUMBER]", "stars": "*" * 12, "partial": "4**********0"}
    r = df.select(F.expr(spans.repair("'x 415-555-0100'", "filter(spans, s -> s.source = 'regex')")).alias("fixed"), F.expr(spans.layer_summary("spans")).alias("n")).first()
    assert [(s.start, s["end"]) for s in r.fixed] == [(2, 14)] and r.n == {"model_window": 1, "regex": 1}


@pytest.mark.parametrize("seed", range(20))
def test_disjoint_spans(seed):
    """The greedy choices against their definition: a span stays if it meets none that stayed before."""
    rng = random.Random(seed)
    made = [{"start": a, "end": a + rng.randint(1, 9), "class": "c", "source": rng.choice(["regex", "kb_rule", "model_window", "other"])} for a in rng.choices(range(60), k=30)]
    for chosen, key in ((spans.for_highlight, lambda s: (-spans.PRIORITY.get(s["source"], 1), s["end"] - s["start"], s["start"])), (spans.for_mask, lambda s: -s["start"])):
        kept = []
        for s in sorted(made, key=key):
            if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
                kept.append(s)
        assert chosen(made) == sorted(kept, key=lambda s: s["start"])


def test_distinct_spans(spark):
    one, two = (5, 9, "a", "x", "regex", "high"), (5, 9, "a", "x", "kb_rule", "med")
    rows = [([two, one, (0, 2, None, "", "", ""), one, (0, 2, None, "y", "", ""), (5, 9, "b", "", "", "")],), ([],)]
    got = spark.createDataFrame(rows, f"spans array<{spans.SPAN}>").selectExpr(f"{spans.distinct('spans')} AS d").collect()
    assert [[tuple(s) for s in r.d] for r in got] == [[two, (0, 2, None, "", "", ""), (5, 9, "b", "", "", "")], []]


def test_many_matches_in_one_text(spark):
    """100,000 matches in a text: found, told apart and replaced in time near linear."""
    n = 100_000
    df = spark.createDataFrame([("é a@b.org," * n,)], "text string")
    start = time.monotonic()
    found = spans.find(df, MAIL).selectExpr("text", f"{spans.distinct('spans')} AS spans")
    r = spans.edit(found, "stars").selectExpr("size(spans) AS n", "element_at(spans, -1).start AS last", "length(edited) AS size", "regexp_count(edited, '[*]{7},') AS masked").first()
    assert tuple(r) == (n, 10 * n - 8, 10 * n, n) and time.monotonic() - start < 60


def test_overlap_pairs(spark):
    rows = [(1, [(0, 4, "a", "", "regex", ""), (3, 6, "b", "", "regex", ""), (6, 8, "c", "", "regex", "")])]
    df = spark.createDataFrame(rows, f"id int, spans array<{spans.SPAN}>")
    assert [(r.one["class"], r.two["class"]) for r in spans.overlap_pairs(df, "id").collect()] == [("a", "b")]


def test_mask_and_hash(spark):
    df = spark.createDataFrame([("id 123-45-6789 mail alice@b.org ab@c.com ip 10.0.0.7",), ("plain",)], "text string")
    m = [r.safe_text for r in remediate.remediate(df, "mask").collect()]
    assert m == ["id ***-**-6789 mail a***e@b.org **@c.com ip ***.***.***.7", "plain"]
    h = remediate.remediate(df, "hash").first().safe_text
    assert re.fullmatch(r"id HASH::[0-9a-f]{16} mail HASH::.* ip HASH::[0-9a-f]{16}", h)


def test_encrypt_round_trip(spark):
    df = remediate.remediate(spark.createDataFrame([("é secret",)], "text string"), "encrypt", password="pw")
    assert df.select(remediate.decrypt(F.col("safe_text"), "pw").alias("t")).first().t == "é secret"
    with pytest.raises(ValueError):
        remediate.remediate(df, "encrypt")


def test_chunks_cover_text(spark):
    t = "".join(chr(97 + i % 26) for i in range(1234))
    rows = scan.chunks(spark.createDataFrame([(1, t), (2, "short"), (3, "")], "doc_id int, text string"), "doc_id").orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(1, 0), (1, 400), (1, 800), (1, 1200), (2, 0)]
    assert all(r.chunk == t[r.start : r.start + 500] for r in rows if r.doc_id == 1)


def test_scan_escalates(spark):
    df = spark.createDataFrame([(1, "x " * 400 + " 4111 1111 1111 1111"), (2, "the weather is nice in the north")], "doc_id int, text string")
    got = {r.doc_id: (r.overall_risk, r.risk_score) for r in scan.scan(df).collect()}
    assert got[1] == ("high", 100) and got[2][0] == "low"


def test_first_of_keeps_nulls_and_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, k string")
    assert sorted(r.id for r in curate.first_of(df, F.col("k"), "id").collect()) == [1, 3, 4]


def test_near_duplicates_brute(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(25)] + [(99, docs[5][1])]
    got = {(r.id, r.item) for r in curate.near_duplicates(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, text string"), "id", "item", threshold=0.4).collect()}
    sets = lambda rows: {i: set(t.split()) for i, t in rows}
    a, b = sets(docs), sets(items)
    want = {(i, j) for i in a for j in b if a[i] and b[j] and len(a[i] & b[j]) / len(a[i] | b[j]) >= 0.4}
    assert got == want and want


def test_split_and_balance(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else "b") for i in range(100)], "id long, label string")
    s = curate.stratified_split(df, "id", "label").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in s} == {("a", "train"): 56, ("a", "validation"): 12, ("a", "test"): 12, ("b", "train"): 14, ("b", "validation"): 3, ("b", "test"): 3}
    assert {r.label: r["count"] for r in curate.oversample(df, "id", "label").groupBy("label").count().collect()} == {"a": 80, "b": 80}
    assert {r.label: r["count"] for r in curate.oversample(df, "id", "label", "min").groupBy("label").count().collect()} == {"a": 20, "b": 20}
    assert {r.label: r["count"] for r in curate.cap_per_class(df, "id", "label", {"a": 7}).groupBy("label").count().collect()} == {"a": 7}
    w = {r.label: r.weight for r in curate.class_weights(df, "label").collect()}
    assert w["b"] == pytest.approx(4 * w["a"]) and sum(w.values()) == pytest.approx(2)
    one = curate.stratified_split(df.union(spark.createDataFrame([(200, "c")], df.schema)), "id", "label").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in one} == {"train": 71, "validation": 15, "test": 15}


def test_metrics_brute(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p double")
    for r in evaluate.sweep(df, evaluate.grid(spark, 10, 90, 20), "y", "p").collect():
        tp = sum(y == 1 and p >= r.threshold for y, p in rows)
        fp = sum(y == 0 and p >= r.threshold for y, p in rows)
        assert (r.tp, r.fp, r.tp + r.fn, r.fp + r.tn) == (tp, fp, sum(y for y, _ in rows), sum(1 - y for y, _ in rows))
    pairs = [(a, b) for y, a in rows if y for z, b in rows if not z]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert evaluate.areas(df, "y", "p").first().roc_auc == pytest.approx(auc)
    assert evaluate.best_two_thresholds(df, spark, "y", "p").count() == 0  # nothing feasible


def test_two_thresholds_feasible(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.7), (1, 0.2), (0, 0.01), (0, 0.1)], "y int, p double")
    r = evaluate.best_two_thresholds(df, spark, "y", "p", min_recall_block=0.6).first()
    assert 0.1 < r.t_warn <= 0.2 and r.t_block <= 0.7 and r.combined_recall == 1.0


def test_resample_and_empty(spark):
    c = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "x double, y double")
    assert [round(r.y, 2) for r in evaluate.resample(c, "x", "y", 5).orderBy("x").collect()] == [1.0, 0.75, 0.5, 0.25, 0.0]
    empty = spark.createDataFrame([], "y int, p double")
    assert evaluate.with_metrics(evaluate.confusion(empty, "y", F.col("p") > 0)).first().f1 == 0.0


def test_events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), 1, v) for i, v in enumerate((5, 40, 3, 2, 90, 1, 1, 1))]
    e = E.normalise(spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, v int"), F.col("ts"), F.col("v"))
    assert [r.action for r in e.orderBy("event_id").collect()] == ["silent", "warn", "silent", "silent", "block", "silent", "silent", "silent"]
    s = E.streaks(e, "user_id").first()
    assert (s.current_streak, s.best_streak) == (3, 3)
    assert E.action_mix(e).first().pct_silent == 75 and E.hour_counts(e).count() == 24 and E.kpis(e).first().n_block == 1
    j = spark.createDataFrame([('{"risk_score": 140}',), ("bad",), ('{"risk_score": "7"}',)], "c string")
    assert [r.s for r in j.select(E.context_score("c").alias("s")).collect()] == [100, 0, 7]


def test_ring():
    assert dedupe.ring(["a", "a", "b", "c", "d", "a", "d"]) == [True, False, True, True, True, True, False]
    assert dedupe.ring(["a", "a"], [False, True]) == [True, True]


def test_streams(spark, tmp_path):
    src, t0 = tmp_path / "in", dt.datetime(2024, 1, 1)
    rows = [(1, t0, "x"), (2, t0 + dt.timedelta(seconds=5), " x "), (3, t0 + dt.timedelta(seconds=9), "y"), (4, t0 + dt.timedelta(seconds=9), "y")]
    schema = "event_id int, ts timestamp, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    q = dedupe.ttl_dedupe(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("ttl").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ttl").count() == 2
    out = str(tmp_path / "out")
    for _ in range(2):
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(ledger.writer(out, "event_id")).start()
        q.processAllAvailable()
        q.stop()
    assert ledger.read(spark, out).count() == 4  # a second run adds nothing


def test_last_three_batch(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("aabcda")], "c int, i int, text string")
    assert [r.analysed for r in dedupe.last_three(df, "c", "i").orderBy("i").collect()] == dedupe.ring(list("aabcda"))


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"content": "one", "sensitivity": "restricted"}\nbad\n{"text": "", "content": "two", "label": "internal"}\n{"sensitivity": "public"}\n')
    rows = {r.text: r.risk for r in readers.sensitivity_corpus(spark, str(tmp_path / "a.jsonl"), "s").collect()}
    assert rows == {"one": "high", "two": "low"}
    (tmp_path / "b.csv").write_text('text,label,expected_action\n"x, y",risky,\nz,medium,silent\n')
    got = {r.text: r.expected_action for r in readers.gate_rows(readers.raw(spark, str(tmp_path / "b.csv"))).collect()}
    assert got == {"x, y": "block", "z": "silent"}
    (tmp_path / "c.bin").write_bytes(b"page \xff text")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    docs = {r.path.rsplit("/", 1)[1]: r for r in readers.documents(spark, f"{tmp_path}/*.[bp]*[nf]").collect()}
    assert docs["c.bin"].text == "page � text" and docs["d.pdf"].error
    rules, sens = readers.knowledge_base(json.dumps({"custom_pii_patterns": [{"name": "n", "regex": "("}, {"name": "ok", "regex": "x"}], "forbidden_terms": ["a.b"], "sensitivity_overrides": {"ID": "block"}}))
    assert [r["name"] for r in rules] == ["ok", "forbidden:a.b"] and sens == {"ID": "block"}


def test_label_readers(spark):
    s = spark.createDataFrame([("[{\"label\":\"ssn\"}]", ""), ("[{\"label\":\"a\"},{\"label\":\"b\"}]", ""), ("[]", "")], "spans string, label string")
    assert [r.risk for r in readers.by_spans(s).collect()] == ["high", "med", "low"]
    m = spark.createDataFrame([("call me on the phone", "call [NAME_1] on [PHONE_2]")], "t string, m string")
    assert readers.masked_templates(m, "t", "m", {"NAME": "NAME", "PHONE": "CONTACT"}).first().label == "CONTACT"
    b = spark.createDataFrame([(["a", "b"], ["O", "B-PASSWORD"])], "tok array<string>, tag array<string>")
    assert tuple(readers.bio_tokens(b, "tok", "tag", {"PASSWORD": "AUTH"}).first()) == ("a b", "AUTH")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(" x ", "ID", 0.5, "warn", 7)], "text string, pii_class string, confidence double, action string, risk_score int")
    writers.append_events(df, str(tmp_path / "log"))
    r = spark.read.parquet(str(tmp_path / "log")).first()
    assert json.loads(r.context_json) == {"risk_score": 7} and len(r.text_hash) == 64
    writers.splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").count() == 1


def test_feedback(spark):
    kind = "text_hash string, line int, predicted string, correct string, used_for_training boolean"
    f = spark.createDataFrame([("h1", 1, "low", "med", False), ("h1", 2, "low", "critical", False), ("h2", 3, "med", "odd", True), ("h3", 4, "low", "low", False)], kind)
    full = spark.createDataFrame([("h1", 1, "  "), ("h2", 2, "t2")], "text_hash string, line int, text string")
    prev = spark.createDataFrame([("h1", 1, "p1"), ("h3", 2, "p3")], "text_hash string, line int, text_preview string")
    assert {(r.text_hash, r.text, r.risk) for r in feedback.to_training(f, full, prev).collect()} == {("h1", "p1", "high"), ("h3", "p3", "low")}
    assert feedback.pending(f, 3).count() == 3 and feedback.pending(f, 4).count() == 0
    assert feedback.mark_used(f, f.where("text_hash = 'h1'")).where("used_for_training").count() == 3
    c = spark.createDataFrame([("x" * 30, "high", [(1, 3, "ID")])], "text string, corrected_risk string, span_fixes array<struct<start:int,end:int,correct_class:string>>")
    assert feedback.correction_rows(c).count() == 1


def test_mask_steps_leave_nulls(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert apply(df, remediate.mask_steps(SPARK, "text")).first()[remediate.LAST] is None


def test_curves_scan_their_input_once(spark, tmp_path):
    """However often a curve is read again, the table behind it is not; scores that crowd at one end are dealt evenly."""
    rows = [(i % 3 == 0, 1 - i / 1e7) for i in range(4000)] + [(True, 0.1), (False, 0.1)]
    spark.createDataFrame(rows, "y boolean, p double").selectExpr("cast(y AS int) AS y", "p").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    curve = evaluate.downsample(evaluate.pr_curve(df, "y", "p"), "p", 96)
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in plan and not any(f in str(tmp_path) for f in curve.inputFiles()) and curve.count() == 96
    h = evaluate.histogram(df, "y", "p").orderBy("p").collect()
    ps = sorted({p for _, p in rows})
    assert [r.p for r in h] == ps and h[0].tp + h[0].fp == len(rows) and h[-1].tp + h[-1].fp == 1
    assert all(a.tp - a.pos == b.tp and a.fp - a.neg == b.fp for a, b in zip(h[:-1], h[1:], strict=True))
