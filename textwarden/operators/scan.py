"""Document scanning: chunks, their scores, and the roll-up to documents.

A chunk is a row, so a very long document is many small rows; the roll-up is one partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.dialect import SPARK
from textwarden.functions.patterns import STRONG
from textwarden.operators import score as S
from textwarden.operators.policy import Policy

SIZE, OVERLAP, LEAST = 500, 100, 20
CRITICAL = ("SSN pattern", "credit card pattern", "IBAN")


def chunks(df: DataFrame, key: str, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, start, chunk): overlapping pieces; texts up to ``size`` stay whole, and the last piece may lie in the one before."""
    last = F.when(F.length(text_col) <= size, F.lit(0)).otherwise(F.length(text_col) - 1)
    return df.where(F.length(text_col) > 0).select(key, text_col, F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start")).select(
        key, "start", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)).alias("chunk"))


def word_windows(df: DataFrame, key: str, text_col: str = "text", size: int = 126, step: int = 94, short: int = 80) -> DataFrame:
    """(key, first, words): sliding windows of words; short texts are one window; the window that reaches the end is the last."""
    d = df.select(key, F.regexp_extract_all(text_col, F.lit(r"\S+"), F.lit(0)).alias("ws"))
    last = F.expr(f"CASE WHEN size(ws) < {short} OR size(ws) <= {size} THEN 0 ELSE cast(ceil((size(ws) - {size}) / {float(step)}D) AS int) * {step} END")
    return d.select(key, "ws", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("first")).select(key, "first", F.slice("ws", F.col("first") + 1, F.lit(size)).alias("words"))


def scan(df: DataFrame, key: str = "doc_id", text_col: str = "text", policy: Policy | None = None) -> DataFrame:
    """One row per document (of a unique key): risk, score, flagged and scored chunks, triggers; one pass and one exchange of partial sums."""
    low = S.seen(text_col)
    seen = df.select(key, F.col(text_col).alias("_text"), *[F.expr(e).alias(c) for c, e in low.items()])
    critical = F.expr(f"coalesce({S.found(SPARK, '_text', [p for p in STRONG if p.name in CRITICAL], S.SEEN)}, false)")
    # the text's own flag goes along with its chunks, of which an empty text has none but one row
    flagged = seen.select(key, "_text", critical.alias("_critical"))
    last = F.when(F.length("_text") <= SIZE, F.lit(0)).otherwise(F.length("_text") - 1)
    starts = F.when(F.length("_text") > 0, F.sequence(F.lit(0), last, F.lit(SIZE - OVERLAP)))
    parts = flagged.select(key, "_critical", "_text", F.explode_outer(starts).alias("_start"))
    parts = parts.select(key, "_critical", F.substring(F.col("_text"), F.col("_start") + 1, F.lit(SIZE)).alias("chunk"))
    parts = parts.withColumn("_ok", F.coalesce(F.length(F.expr(SPARK.strip("chunk"))) >= LEAST, F.lit(False)))
    parts = parts.withColumn("chunk", F.when(F.col("_ok"), F.col("chunk")))
    scored = S.score(parts, "chunk", policy=policy)
    rank = F.when(F.col("_ok"), F.expr("CASE action WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END"))
    out = scored.groupBy(key).agg(
        F.max(F.when(F.col("_ok"), F.col("risk_score"))).alias("top"), F.max(rank).alias("act"), F.sum(F.col("_ok").cast("int")).alias("chunks_scored"),
        F.sum(F.when(rank > 0, 1).otherwise(0)).alias("flagged_chunks"), F.max("_critical").alias("page_critical"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_ok"), F.col("triggers")))))).alias("triggers"))
    act = F.when(F.col("page_critical"), 2).otherwise(F.coalesce("act", F.lit(0)))
    return out.select(
        key,
        F.when(act == 2, "high").when(act == 1, "med").otherwise("low").alias("overall_risk"),
        F.when(F.col("page_critical"), 100).otherwise(F.coalesce("top", F.lit(0))).cast("int").alias("risk_score"),
        F.coalesce("chunks_scored", F.lit(0)).cast("long").alias("chunks_scored"),
        F.coalesce("flagged_chunks", F.lit(0)).cast("long").alias("flagged_chunks"),
        F.coalesce("triggers", F.array().cast("array<string>")).alias("triggers"),
    )
