"""Windows of a text hold their own tokens only."""

from pyspark.sql import functions as F

from textwarden.operators import tokens


def test_windows_of_a_long_text_hold_only_their_own(spark):
    """No plan step repeats a whole text, or all its tokens, for each of its windows: 2 MB of text would be terabytes."""
    n = 1_000_000
    d = spark.range(1).select("id", F.expr(f"concat(repeat('é ', {n}), '@')").alias("text"))
    w = tokens.windows(tokens.encode(d, [" é"]), "id", short=0)
    assert "Generate" not in w._jdf.queryExecution().executedPlan().toString()
    got = w.selectExpr("count(1) AS n", "max(size(starts)) AS most", "max(length(part)) AS part", "sum(cast(contains(part, '@') AS int)) AS hits", "max(char_end) AS z").first()
    step = tokens.CONTENT - tokens.SHARED
    size = n + 3  # the first letter has two bytes, and no space before it; the last space and the sign are bytes, too
    assert (got.n, got.most, got.hits, got.z) == (-(-(size - tokens.CONTENT) // step) + 1, tokens.CONTENT, 1, 2 * n + 1) and got.part <= 2 * tokens.CONTENT
