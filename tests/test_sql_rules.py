"""Queries against their SQL where letters beyond ASCII stand beside words, and on more rows than a split holds."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from textwarden.functions.dialect import CHECK
from textwarden.functions.patterns import FINGERPRINT
from textwarden.plans import catalog

TEXTS = (
    "call 3280 zuch stöbe zu ene", "12 main st", "STRAßE ALT", "STRASSE ALT", "ß", "müller@x.de and ok@y.com", "é@x.com é.a@y.de é%b@y.de öab.c@d.eé a@b.deé ab@c.de",
    "éé_é12345é abc123é é99 99 9é9 ABé-123 ab-123 cafebabeé cafebabe", "project übung, project x", "_é_ a_é a@b.com_é 123456789é 123456789", None, "",
)


def compare(spark, name, df):
    got = catalog.ALL[name].run(lambda _: df, spark)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    rel = con.sql(catalog.oracle_sql()[name])
    cols = rel.columns
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["trigger_counts", "kb_rules", "regex_match_counts", "risk_tier_counts", "chunk_scan_rollup", "text_keys", "miss_patterns"])
def test_letters_beyond_ascii(spark, name):
    rows = [(4 * i + k, t) for i, t in enumerate(TEXTS) for k in range(4)]
    compare(spark, name, spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("rx,to", FINGERPRINT[:5])
def test_placeholders_in_sql(rx, to):
    con = duckdb.connect()
    for t in TEXTS:
        if t is not None:
            got = con.execute(f"SELECT {CHECK.sub('x', rx, to)}, {CHECK.count('x', rx)} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchall()
            assert got == [(re.sub(rx, to, t), len(re.findall(rx, t)))]


def test_more_rows_than_the_splits_hold(spark):
    compare(spark, "span_corpus_splits", spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
