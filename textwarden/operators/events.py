"""Dashboards over an event log (event_id, ts, action, risk_score, pii_class, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise(events: DataFrame, ts: Column, score: Column, action: Column | None = None, classes: Column | None = None) -> DataFrame:
    """events with ts, risk_score in 0..100, action (from the score where missing) and the list of classes."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(score, F.lit(0)))).cast("int")
    derived = F.when(s >= 80, "block").when(s > 30, "warn").otherwise("silent")
    d = events.withColumns({"ts": ts, "risk_score": s}).withColumn("action", F.coalesce(action, derived) if action is not None else derived)
    parts = F.filter(F.transform(F.split(classes, r"[;,|]"), F.trim), lambda x: x != "") if classes is not None else F.array().cast("array<string>")
    return d.withColumn("classes", parts)


def context_score(json: str, path: str = "$.risk_score") -> Column:
    """A number of a JSON context, within 0..100; 0 if it can't be read."""
    return F.expr(f"cast(greatest(0, least(100, coalesce(try_cast(get_json_object({json}, '{path}') AS double), 0))) AS int)")


def recent(events: DataFrame, n: int, order: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc(order)).limit(n)


def action_mix(events: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    parts = [F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(f"n_{a}") for a in ("block", "warn", "silent")]
    d = events.agg(n.alias("n"), *parts, F.avg("risk_score").alias("mean_score"))
    pct = {f"pct_{a}": F.when(F.col("n") == 0, 0).otherwise(F.floor(100 * F.col(f"n_{a}") / F.col("n") + 0.5)).cast("int") for a in ("block", "warn", "silent")}
    return d.withColumns(pct)


def score_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(F.least(F.lit(9), F.floor(F.col("risk_score") / 10)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hour_counts(events: DataFrame) -> DataFrame:
    """24 rows; heat is the sum of score / 100 over the largest such sum, at least 1."""
    h = events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), (F.sum("risk_score") / 100).alias("load"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    d = hours.join(h, "hour", "left").fillna(0, ["n", "load"])
    return d.withColumn("heat", F.col("load") / F.greatest(F.max("load").over(Window.partitionBy()), F.lit(1.0)))


def _days(events: DataFrame, n: int) -> DataFrame:
    """The last n days up to the newest event."""
    newest = events.agg(F.max(F.to_date("ts")).alias("d"))
    return newest.select(F.explode(F.sequence(F.date_sub("d", n - 1), F.col("d"))).alias("day"))


def daily_trend(events: DataFrame, n: int = 7) -> DataFrame:
    """Zero-filled days with a count for each action."""
    c = events.groupBy(F.to_date("ts").alias("day")).agg(*[F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(f"n_{a}") for a in ("block", "warn", "silent")])
    return _days(events, n).join(c, "day", "left").fillna(0, ["n_block", "n_warn", "n_silent"])


def daily_mean(events: DataFrame, n: int = 7) -> DataFrame:
    """Days with the rounded mean score, null without events."""
    c = events.groupBy(F.to_date("ts").alias("day")).agg(F.floor(F.avg("risk_score") + 0.5).cast("int").alias("mean_score"))
    return _days(events, n).join(c, "day", "left")


def top_classes(events: DataFrame, cls: str, k: int = 8, without: tuple[str, ...] = ("", "low")) -> DataFrame:
    """Most frequent classes; ties go to the one seen first."""
    g = events.where(~F.col(cls).isin(*without)).groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen"))
    return g.orderBy(F.desc("n"), "first_seen").limit(k)


def streaks(events: DataFrame, who: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Per user: current run of silent events from the newest, and the longest run.

    Runs are islands between breaks (warn or block), numbered by the breaks before.
    """
    w = Window.partitionBy(who).orderBy(*order)
    bad = F.col("action").isin("warn", "block")
    runs = events.withColumn("_run", F.sum(F.when(bad, 1).otherwise(0)).over(w)).groupBy(who, "_run").agg(F.sum(F.when(bad, 0).otherwise(1)).alias("n"))
    return runs.groupBy(who).agg(F.max_by("n", "_run").alias("current_streak"), F.max("n").alias("best_streak"))


def day_streaks(events: DataFrame, who: str, gap: int = 2, milestones: tuple[int, ...] = (5, 10, 25, 50, 100)) -> DataFrame:
    """Per user: the last chain of active days with less than ``gap`` days between, and the milestone it has reached."""
    days = events.select(who, F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy(who).orderBy("day")
    far = F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(gap)) >= gap
    chain = days.withColumn("_c", F.sum(F.when(far, 1).otherwise(0)).over(w)).groupBy(who, "_c").agg(F.count(F.lit(1)).alias("days"))
    last = chain.groupBy(who).agg(F.max_by("days", "_c").alias("days"))
    mark = F.lit(0)
    for m in milestones:
        mark = F.when(F.col("days") >= m, m).otherwise(mark)
    return last.withColumn("milestone", mark)


def risk_rollup(events: DataFrame, risk: str) -> DataFrame:
    known = F.when(F.col(risk).isin("low", "med", "high"), F.col(risk)).otherwise("unknown")
    return events.groupBy(known.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def kpis(events: DataFrame, days: int = 7, fallback: int = 400) -> DataFrame:
    """Count and blocks of the last days; of the newest ``fallback`` rows where these days are empty."""
    newest = events.agg(F.max("ts").alias("now"))
    d = events.join(F.broadcast(newest)).where(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    one = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("action") == "block", 1).otherwise(0)), F.lit(0)).alias("n_block"))
    rest = recent(events, fallback).agg(F.count(F.lit(1)).alias("n2"), F.coalesce(F.sum(F.when(F.col("action") == "block", 1).otherwise(0)), F.lit(0)).alias("b2"))
    return one.join(F.broadcast(rest)).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("n2")).alias("n"), F.when(F.col("n") > 0, F.col("n_block")).otherwise(F.col("b2")).alias("n_block"))


def persona(events: DataFrame, who: str) -> DataFrame:
    """Per user the share of blocked events and the band it falls in."""
    d = events.groupBy(who).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("n_block"))
    pct = 100 * F.col("n_block") / F.col("n")
    return d.withColumn("band", F.when(pct >= 30, 4).when(pct >= 15, 3).when(pct >= 5, 2).when(pct > 0, 1).otherwise(0))
