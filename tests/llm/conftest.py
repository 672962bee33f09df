import random

import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("block", "bucket", "node", "row", "copy", "matches", "_hits", "size", "target", "draw", "toxic_score", "n_tokens", "words", "rest")


def passage(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, ties, repeated rows, near copies, shared passages, long and strange texts."""
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("ra", "ne", "ti") for c in ("s", "n", "é", "ß")]
    shared, other = passage(rng, vocab, 60), passage(rng, vocab, 35)
    base = passage(rng, vocab, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "one", "One", "one two three", "émile ñandú 漢字 😀", "a" * 3000, "x y " * 900, "\x0b|\x0c#&% <b>",
        base, base, base.upper(), " ".join(near), base + "\n" + base, shared, passage(rng, vocab, 20) + "  " + shared + "\n" + passage(rng, vocab, 30),
        other + " tail", "head " + other, other.rsplit(" ", 1)[0], passage(rng, vocab, 4000) + " " + shared, "no break space word",
    ]
    texts += [passage(rng, vocab, rng.randint(3, 160)) + rng.choice([".", "!", "\n", ""]) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(10, base, "en", "a", len(base)), (10, base, "en", "a", len(base)), (None, base, None, None, 5), (None, "lone text of a row without id", None, "b", 5), (7, "same id, other text", "en", "c", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, KIND).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)
