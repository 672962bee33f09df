"""Entities are built by columns and counted in their row."""

from tests.test_tagger_batches import plain
from textwarden.operators import layers
from textwarden.plans import tagger_queries


def test_entities_are_counted_in_their_row(spark):
    some = ["Ask Ada Quill now or Ada Quill. it is 12.5 and 7", "none here", None]
    d = spark.createDataFrame([*enumerate(some)], "doc_id long, text string")
    out = tagger_queries._entities(lambda name: d, spark)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    found = {k: [x for x in plain(tagger_queries.FIXED, some[0]) if x[2] == k] for k in ("NAME", "NUM")}
    assert all(found.values()) and {(r.doc_id, r.label, r.n, r.start_sum, r.end_sum) for r in out.collect()} == {(0, k, len(x), sum(a for a, _, _ in x), sum(z for _, z, _ in x)) for k, x in found.items()}


def test_entity_columns(spark):
    d = spark.createDataFrame([(1, "ab cd"), (2, None), (3, "")], "id int, text string")
    tag = lambda texts: [[(0, 2, "K"), (3, 5, "other"), (3, 5, "K")] if t else [] for t in texts]
    got = {r.id: [tuple(e) for e in r.entities] for r in layers.tag(d, lambda: tag, types={"K": "kind"}).collect()}
    assert got == {1: [(0, 2, "K", "kind", 0.85, "ab"), (3, 5, "K", "kind", 0.85, "cd")], 2: [], 3: []}
