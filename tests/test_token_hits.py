"""Hits on the tokens of windows take time in proportion to a text."""

import time

from textwarden.plans import token_queries


def test_hits_in_a_long_text(spark):
    d = spark.createDataFrame([(1, "né@x " * 12000), (2, "none"), (3, None)], "doc_id long, text string")
    start = time.time()
    rows = token_queries._token_hits(lambda name: d, spark).collect()
    assert [(r.doc_id, r.n, r.start_sum) for r in rows] == [(1, 12000, sum(range(2, 60000, 5)))]
    assert time.time() - start < 90
