"""Feedback rows to training rows, review state and the uncertainty queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions import text as X
from textwarden.functions.dialect import SPARK


def pending(feedback: DataFrame, least: int = 10) -> DataFrame:
    """Unused rows; none if there are fewer than ``least``."""
    open_ = feedback.where("NOT used_for_training")
    return open_.join(F.broadcast(open_.agg((F.count(F.lit(1)) >= least).alias("_ok")))).where("_ok").drop("_ok")


def latest(feedback: DataFrame, key: str = "text_hash", order: tuple[str, ...] = ("line",)) -> DataFrame:
    """The last row of each key."""
    cols = [F.col(f"`{c}`") for c in feedback.columns]
    return feedback.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")


def to_training(feedback: DataFrame, full: DataFrame, preview: DataFrame) -> DataFrame:
    """Latest feedback of each hash with its full text, else its preview; rows without text or a known risk go."""
    f = latest(feedback).join(latest(full, order=("line",)).select("text_hash", "text"), "text_hash", "left").join(latest(preview, order=("line",)).select("text_hash", "text_preview"), "text_hash", "left")
    text = F.coalesce(*[F.when(F.expr(SPARK.strip(c)) != "", F.col(c)) for c in ("text", "text_preview")])
    return f.select("text_hash", text.alias("text"), F.expr(X.risk_name(SPARK, "correct")).alias("risk")).where("text IS NOT NULL AND risk IS NOT NULL")


def correction_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.concat_ws("->", "predicted", "correct").alias("change")).agg(F.count(F.lit(1)).alias("n"))


def mark_used(feedback: DataFrame, used: DataFrame, key: str = "text_hash") -> DataFrame:
    hit = feedback.join(used.select(key).distinct().withColumn("_u", F.lit(True)), key, "left")
    return hit.withColumn("used_for_training", F.coalesce("_u", "used_for_training")).select(*feedback.columns)


def stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("used_for_training"), 0).otherwise(1)).alias("pending"), F.sum(F.when(F.col("used_for_training"), 1).otherwise(0)).alias("used"))


def correction_rows(corrections: DataFrame, around: int = 96, least: int = 20, most: int = 1000) -> DataFrame:
    """(text, risk) of approved corrections: whole texts and snippets around each fix, one for each fingerprint and risk."""
    whole = corrections.select("text", F.col("corrected_risk").alias("risk"))
    fix = corrections.select("text", F.explode("span_fixes").alias("f"))
    lo = F.greatest(F.lit(0), F.col("f.start") - around)
    snippet = fix.select(F.substring(F.col("text"), lo + 1, F.col("f.end") + around - lo).alias("text"), F.expr(X.mapped("upper(f.correct_class)", X.TRAINING_RISK, "med")).alias("risk"))
    rows = whole.unionByName(snippet).where(F.length("text").between(least, most))
    return rows.groupBy(F.expr(X.fingerprint(SPARK, "text")).alias("_f"), "risk").agg(F.min("text").alias("text")).select("text", "risk")


def uncertainty_queue(df: DataFrame, probs: str, key: str, k: int = 200) -> DataFrame:
    """The k rows whose best class is least likely, with the second best."""
    ranked: Column = F.sort_array(probs, asc=False)
    return df.select(key, (1 - ranked[0]).alias("uncertainty"), ranked[1].alias("second")).orderBy(F.desc("uncertainty"), key).limit(k)


#: Characters of a text that the index of hashes keeps.
PREVIEW = 500


def record(df: DataFrame, text: str = "text", predicted: str = "predicted", correct: str = "correct", at: str = "at", source: str = "user", keep_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Three tables to append: the feedback rows, (text_hash, text_preview), and (text_hash, text) unless texts aren't to be kept.

    The hash is of the text as it is, not stripped. ``risk_score`` and ``feedback_type`` go along where df has them.
    """
    d = df.where(F.col(text).isNotNull()).withColumn("text_hash", F.sha2(F.col(text), 256))
    more = [F.col(c) for c in ("risk_score", "feedback_type") if c in df.columns]
    rows = d.select(F.col(at).alias("timestamp"), "text_hash", F.col(predicted).alias("predicted"), F.col(correct).alias("correct"), F.lit(source).alias("source"), F.lit(False).alias("used_for_training"), *more)
    return rows, d.select("text_hash", F.substring(text, 1, PREVIEW).alias("text_preview")), d.select("text_hash", F.col(text).alias("text")) if keep_text else None


def export_rows(bubble: DataFrame, corrections: DataFrame) -> DataFrame:
    """(text, risk, merge_source) of both exports; rows without text or a known risk go."""
    def usable(df: DataFrame, name: str) -> DataFrame:
        pick = lambda *names: F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in names if c in df.columns])
        d = df.select(F.trim(pick("text", "content")).alias("text"), pick("risk", "label").alias("_r"))
        return d.select("text", F.expr(X.risk_name(SPARK, "_r")).alias("risk"), F.lit(name).alias("merge_source")).where("text IS NOT NULL AND risk IS NOT NULL")

    return usable(bubble, "bubble_export").unionByName(usable(corrections, "span_export"))


def review(rows: DataFrame, line: str, approved: list[int]) -> DataFrame:
    return rows.withColumn("review_status", F.when(F.col(line).isin(*approved), "approved").otherwise(F.col("review_status"))) if approved else rows
