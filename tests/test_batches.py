"""Python steps on batches of long texts hold little at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from textwarden.functions.batches import PIECE_BYTES, pieces
from textwarden.operators import build, layers, tokens


def test_pieces():
    texts = ["a" * 6, None, "é" * 3, "", "b" * 30, "c", "d" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "text"])
    cut = list(pieces(iter([batch, batch.slice(0, 0)]), "text", 12))
    assert [b.column(0).to_pylist() for b in cut] == [[0, 1, 2, 3], [4], [5, 6]]
    assert [t for b in cut for t in b.column(1).to_pylist()] == texts


def _long(spark, n=12):
    return spark.range(n).coalesce(1).select("id", F.expr(f"repeat('word ', {PIECE_BYTES // 10})").alias("text"))


def test_steps_see_bounded_text(spark):
    def load():
        def encode(texts):
            assert sum(map(len, texts)) <= PIECE_BYTES
            return [[1] for _ in texts]

        return encode

    def load_tagger():
        def tag(texts):
            assert sum(map(len, texts)) <= PIECE_BYTES
            return [[] for _ in texts]

        return tag

    assert build.tokenise(_long(spark), load, length=4).count() == 12
    assert layers.tag(_long(spark), load_tagger).where("size(entities) = 0").count() == 12


def test_encode_and_decode_in_the_row(spark):
    d = spark.createDataFrame([(1, "two wörds"), (2, None), (3, "")], "id int, text string")
    enc = tokens.encode(d, ["two"])
    back = tokens.decode(enc, ["two"], "id")
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.text for r in back.collect()} == {1: "two wörds", 2: "", 3: ""}
