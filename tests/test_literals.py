"""Span lists as JSON and as Python literals."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from textwarden.sources import readers


def words(rng):
    return "".join(rng.choice(["a", "'", '"', "\\", "None", ",]", "é", "\n", "x41", " (", "\x07"]) for _ in range(rng.randrange(7)))


@pytest.mark.parametrize("seed", range(4))
def test_literals(spark, seed):
    """Whatever Python writes for lists of dictionaries is read as Python reads it."""
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        v = [{"label": words(rng), "start": rng.choice([None, 3, -1]), words(rng): (True, False, None, 1.5, (1, [2]), words(rng))} for _ in range(rng.randrange(4))]
        rows.append((repr(v), json.dumps(v)))
    df = spark.createDataFrame(rows, "lit string, js string")
    for r in df.select("lit", "js", F.expr(readers.literal_to_json("lit")).alias("a"), F.expr(readers.literal_to_json("js")).alias("b")).collect():
        assert json.loads(r.a) == json.loads(r.js) == json.loads(r.b), (r.lit, r.a)


def test_risks(spark):
    both = lambda v: [(json.dumps(v),), (repr(v),), (repr(tuple(v)) + "  ",)]
    cases = {
        "high": [[{"label": "SSN_1"}], [{"label": "a"}] * 4, [{"label": "Critical_Secret x"}], [{"label": "it's a 'password'"}]],
        "med": [[{"label": "a"}, {"label": None}], ["odd", {"label": "b"}], [{"label": "a"}, {"no": 1}, {"label": "b\\x"}]],
        "low": [[], [{"label": "a"}], [{"label": "x", "note": "ssn"}]],
    }
    rows = [(*t, risk) for risk, vs in cases.items() for v in vs for t in both(v)] + [("not a list", "low"), (None, "low"), ("[{'label': 'ssn'", "low")]
    got = readers.by_spans(spark.createDataFrame(rows, "spans string, want string")).collect()
    assert [(r.spans, r.risk) for r in got] == [(r.spans, r.want) for r in got]
    assert ast.literal_eval("[{'label': 'a\\x41'}]") == [{"label": "aA"}]
