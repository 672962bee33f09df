"""Pages: spans from chunks are those of the whole page, wherever the cuts lie."""

import random

from pyspark.sql import functions as F

from textwarden.functions.patterns import STRONG
from textwarden.operators import pages, spans

SEEN = tuple(p for p in STRONG if p.name in ("email address", "bank routing number", "IP address (IPv4)"))


def test_chunks_against_whole_pages(spark):
    """Addresses and numbers across cuts; ten digits that a cut makes nine are no routing number."""
    rng = random.Random(2)
    words = ["a.b@mail.example.org", "123456789", "1234567890", "10.20.30.40", "text", "é", "x" * 30]
    rows = [(i, rng.randrange(3), " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(25)] + [(90, 0, None), (91, 0, "")]
    df = spark.createDataFrame(rows, "id int, page int, text string")
    got = pages.chunk_spans(df, ["id", "page"], SEEN, size=60, overlap=40)
    want = spans.find_all(df, SEEN).selectExpr("id", "page", "inline(spans)")
    key = lambda d: sorted((r.id, r.page, r["class"], r.start, r["end"]) for r in d.collect())
    assert key(got) == key(want) and len(key(want)) > 200


def test_longer_than_the_overlap(spark):
    """A match that no chunk holds comes from its pieces."""
    long = "a" * 150 + "@example.org"
    df = spark.createDataFrame([(1, "so " + long + " end")], "id int, text string")
    got = pages.chunk_spans(df, ["id"], SEEN[:1] if SEEN[0].name == "email address" else SEEN, size=200, overlap=100)
    assert [(r.start, r["end"]) for r in got.collect()] == [(3, 3 + len(long))]


def test_scan_and_rollup(spark):
    docs = spark.createDataFrame([("a", "plain words of no interest at all here " * 3 + "mail x@y.org and card 4111 1111 1111 1111 for the bill of today"), ("b", ""), ("c", None)], "id string, text string")
    cut = pages.cut(docs, "id", size=100)
    assert {(r.id, r.page): r.page_offset for r in pages.placed(cut, "id").collect()} == {("a", 0): 0, ("a", 1): 100, ("b", 0): 0, ("c", 0): 0}
    rows = {r.id: r for r in pages.rollup(pages.page_scan(cut, "id"), "id").collect()}
    a = rows["a"]
    assert (a.overall_risk, a.risk_score, a.page_count, a.flagged_pages) == ("high", 100, 2, [1]) and "credit card pattern" in a.pii_classes
    text = docs.where(F.col("id") == "a").first().text
    assert text[a.findings[0].start : a.findings[0]["end"]] == "x@y.org"
    assert all((rows[k].overall_risk, rows[k].issue_count, rows[k].page_count) == ("low", 0, 1) for k in "bc")
