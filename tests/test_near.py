import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textwarden.operators import curate, near


def made(seed, n, vocab, most):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(vocab)], k=rng.randint(0, most))) for _ in range(n)]
    return [t if rng.random() < 0.6 else " ".join(w for w in rng.choice(texts).split() if rng.random() < 0.9) for t in texts]


def wanted(docs, items, t):
    sets = lambda rows: [(i, set((x or "").split())) for i, x in rows]
    return Counter((i, j, round(len(a & b) / len(a | b), 9)) for i, a in sets(docs) for j, b in sets(items) if a and b and len(a & b) / len(a | b) >= t)


def found(spark, docs, items, t):
    out = curate.near_duplicates(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, text string"), "id", "item", threshold=t)
    return Counter((r[0], r[1], round(r[2], 9)) for r in out.collect())


@pytest.mark.parametrize("small", [False, True])
def test_cells_lose_no_pair(spark, monkeypatch, small):
    """Many slices, shares and steps give what one cell gives; sizes from 1 to 80 words."""
    if small:
        for name, size in (("SLICE", 300), ("SHARE", 2000), ("STEP", 150)):
            monkeypatch.setattr(near, name, size)
    texts = made(1, 260, 90, 80)
    docs, items = list(enumerate(texts[:200])), list(enumerate(texts[150:]))
    for t in (0.62, 0.8, 1.0):
        want = wanted(docs, items, t)
        assert found(spark, docs, items, t) == want and want


def test_repeated_and_null_ids_are_rows(spark):
    """The SQL compares rows, so a null id has pairs too and rows of one id aren't mixed."""
    docs = [(1, "a b c d e"), (1, "v w x y z"), (None, "a b c d"), (2, None), (3, "")]
    items = [(7, "a b c d e"), (None, "v w x y z"), (7, "a b c d e"), (8, None)]
    want = wanted(docs, items, 0.62)
    assert want[1, 7, 1.0] == 2 and want[1, None, 1.0] == 1 and found(spark, docs, items, 0.62) == want


def test_common_words_make_no_pairs(spark):
    """Texts that share half of their words, all of them common, are never paired, so nothing is moved for them."""
    common = " ".join(f"c{i}" for i in range(30))
    sets = lambda tag, n: spark.range(n).select(F.col("id").alias("row"), F.split(F.concat(F.lit(common), *[F.concat(F.lit(f" {tag}{j}x"), F.col("id") % 9 if j < 3 else F.col("id")) for j in range(30)]), " ").alias("set")).withColumn("key", F.col("row"))
    assert near.near_rows(sets("p", 200), sets("q", 100), 0.62).count() == 0
    assert near.near_rows(sets("p", 200), sets("p", 100), 0.62).count() == 100


def test_colliding_hashes_lose_no_pair(spark):
    """Tokens of one hash count once in a cell, which is allowed for."""
    low = spark.range(200000).select(F.concat(F.lit("t"), F.col("id")).alias("w"))
    twins = low.groupBy(F.hash("w").alias("h")).agg(F.collect_list("w").alias("ws")).where("size(ws) > 1").limit(4).collect()
    assert len(twins) >= 2
    text = " ".join(w for r in twins[:2] for w in r.ws)
    docs, items = [(1, text + " a b c"), (2, text)], [(1, text + " a b d"), (2, text)]
    assert found(spark, docs, items, 0.62) == wanted(docs, items, 0.62)


def test_equal_sets_are_compared_once(spark):
    """Copies, also with words in another order, are one set in the cells and pairs of their own in the result."""
    docs = [(i, "a b c d e" if i % 2 else "e d c b a a") for i in range(40)]
    items = [(i, "a b c d f") for i in range(3)] + [(i, "c a b d e") for i in range(3, 10)]
    rows = lambda r: spark.createDataFrame(r, "row long, text string").select("row", F.expr("array_distinct(split(text, ' '))").alias("set")).withColumn("key", F.array_join(F.sort_array("set"), " "))
    assert [tuple(r)[1:] for r in near.near_rows(rows(docs), rows(items), 0.62).orderBy("other").collect()] == [(0, 0), (0, 3)]
    want = wanted(docs, items, 0.62)
    assert found(spark, docs, items, 0.62) == want and sum(want.values()) == 400
