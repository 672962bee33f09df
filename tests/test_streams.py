"""Coalescing, rings, ledgers and re-sync: streams fed file by file against the same rows as a table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textwarden.streaming import coalesce, dedupe, ledger

DAY = dt.datetime(2024, 3, 1)


def jobs_want(rows, busy):
    out, running = {}, {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        if key not in running or (at - running[key]).total_seconds() >= busy:
            running[key] = at
            out[key, at] = -1
        out[key, running[key]] += 1
    return out


def requests(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("aaaaaab") if i % 7 else "c", DAY + dt.timedelta(seconds=rng.randrange(2000), milliseconds=rng.randrange(3) * 500)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_coalesced_table(spark, seed):
    rows = [*requests(seed), (None, DAY), (None, DAY), ("a", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp").withColumn("job_start", F.lit("clash"))
    got = {(r.k, DAY + dt.timedelta(microseconds=r.job_start) - (DAY - dt.datetime(1970, 1, 1))): r.merged for r in coalesce.jobs(df.repartition(5), ["k"], "ts", 60).collect()}
    assert got == {**jobs_want([r for r in rows if None not in r], 60), (None, DAY): 1}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", coalesce.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, tmp_path, schema, batches, make, name):
    """The rows that a stream over one file after another gives, and the state rows after each."""
    src = tmp_path / "in"
    src.mkdir()
    df = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q, held = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start(), []
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
            q.processAllAvailable()
            held.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) if i >= 0 else 0)
    finally:
        q.stop()
    return spark.table(name).collect(), held


def test_coalesced_stream(spark, tmp_path, rocks):
    """Repeats inside and outside the window, across batches; state is gone once all jobs have ended."""
    at = lambda s: DAY + dt.timedelta(seconds=s)
    batches = [[("a", at(0)), ("a", at(10)), ("b", at(5))], [("a", at(59)), ("a", at(60)), ("b", at(64))], [("z", at(500))], [("z", at(5000))]]
    got, held = fed(spark, tmp_path, "k string, ts timestamp", batches, lambda s: coalesce.coalesced_stream(s, "k"), "coalesced")
    told = sorted((r.key, r.what, r.at_ms // 1000 - int((DAY - dt.datetime(1970, 1, 1)).total_seconds()), r.merged) for r in got)
    assert told[:6] == [("a", "ended", 60, 2), ("a", "ended", 120, 0), ("a", "started", 0, 0), ("a", "started", 60, 0), ("b", "ended", 65, 1), ("b", "started", 5, 0)]
    assert ("z", "ended", 560, 0) in told and held[-1] < held[1]


def test_last_three_stream(spark, tmp_path, rocks):
    """The ring goes on from batch to batch; keys are forgotten once they have been idle."""
    texts = "aabcdabda"
    rows = [("k", i, t, DAY + dt.timedelta(seconds=i)) for i, t in enumerate(texts)]
    batches = [rows[a : a + 3] for a in (0, 3, 6)]
    kind = "c string, i int, text string, ts timestamp"
    plain, _ = fed(spark, tmp_path, kind, batches, lambda s: dedupe.last_three_stream(s, "c", "i"), "ring")
    assert [r.analysed for r in sorted(plain, key=lambda r: r.i)] == dedupe.ring(list(texts))
    later = DAY + dt.timedelta(hours=2)
    (tmp_path / "more").mkdir()
    more = [*batches, [("z", 20, "a", later)], [("z", 21, "b", later + dt.timedelta(hours=2))], [("k", 30, "a", later + dt.timedelta(hours=3))]]
    timed, held = fed(spark, tmp_path / "more", kind, more, lambda s: dedupe.last_three_stream(s, "c", "i", ts="ts", idle=3600), "timed")
    want = [*dedupe.ring(list(texts)), True, True, True]  # the last "a" of k comes after it was forgotten
    assert [r.analysed for r in sorted(timed, key=lambda r: r.i)] == want


def test_ledger(spark, tmp_path):
    """A repeated and a torn batch change nothing; a batch of new keys reads no older part, one of old keys those parts only."""
    path, write = str(tmp_path / "log"), ledger.writer(str(tmp_path / "log"), "id", buckets=4)
    batch = lambda a, b: spark.range(a, b).selectExpr("id", "concat('v', id) AS v")
    with pytest.raises(ValueError, match="no entered rows"):
        ledger.read(spark, path)
    assert [write(batch(100 * i - 50, 100 * i + 50), i) for i in range(8)] == [0] * 8
    assert write(batch(0, 5000), 3) == 0 and ledger.read(spark, path).count() == 800  # entered already
    batch(7000, 7100).selectExpr("*", "'' AS _rank", "1 AS bucket", "9 AS epoch").write.partitionBy("bucket", "epoch").mode("append").parquet(f"{path}/data")
    assert ledger.read(spark, path).count() == 800  # torn: not in the ledger
    assert 0 < write(batch(740, 760), 9) <= 4
    d = ledger.read(spark, path)
    assert d.count() == d.select("id").distinct().count() == 810 and d.where("id >= 7000").count() == 0 and set(d.columns) >= {"id", "v", "bucket", "epoch"}
    assert write(batch(0, 100), 10) > 0 and ledger.read(spark, path).count() == 810  # all there already
    text = ledger.writer(str(tmp_path / "text"), "k", buckets=2)
    rows = [("b",), ("a",), ("a",), (None,), (None,), ("-5",), ("30",), ("4",)]
    text(spark.createDataFrame(rows, "k string"), 0)
    text(spark.createDataFrame(rows, "k string"), 1)
    assert sorted(str(r.k) for r in ledger.read(spark, str(tmp_path / "text")).collect()) == ["-5", "30", "4", "None", "a", "b"]


@pytest.mark.parametrize("seed", range(3))
def test_resync(spark, seed):
    """The changes make the target equal to the source; only ranges that differ are read."""
    rng = random.Random(seed)
    a = {i: (rng.choice(["x", None]), rng.random()) for i in range(2000)}
    b = dict(a)
    for i in rng.sample(range(2000), 6):
        b.pop(i) if i % 3 == 0 else b.__setitem__(i, ("changed", 0.5))
    b[5000] = ("gone", 1.0)
    make = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, s string, v double").repartition(3)
    one, two = make(a), make(b)
    for r in ledger.changes(one, two, ["k"], ["s", "v"], bits=10).collect():
        assert (r.what == "insert") == (r.k not in b) and (r.what == "delete") == (r.k not in a)
        b.pop(r.k) if r.what == "delete" else b.__setitem__(r.k, (r.s, r.v))
    assert a == b
    da, db = (ledger.digests(d, ["k"], ["s", "v"], 10) for d in (one, two))
    parts = {r.part for r in ledger.differing(da, db, 10, 4).collect()}
    assert parts == {r.part for r in ledger.differing(da, db, 10, 10).collect()} and 1 <= len(parts) <= 7
    assert ledger.differing(da, da, 10).count() == 0
    assert {r.what for r in ledger.changes(one, two.limit(0), ["k"], ["s", "v"], bits=4).collect()} == {"insert"}
