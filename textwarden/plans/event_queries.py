"""Queries on event logs, streams of texts and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.operators import events as E
from textwarden.operators import feedback as FB
from textwarden.plans.common import EVENTS, Query, events
from textwarden.streaming import dedupe

_N = "sum(CASE WHEN {} THEN 1 ELSE 0 END)::BIGINT"
_MIX = ", ".join(f"{_N.format(f'action = {chr(39)}{a}{chr(39)}')} AS n_{a}" for a in ("block", "warn", "silent"))
_DAYS = "SELECT unnest(generate_series(d - INTERVAL 6 DAY, d, INTERVAL 1 DAY))::DATE AS day FROM (SELECT max(ts)::DATE::TIMESTAMP AS d FROM e)"
_RUNS = "r AS (SELECT user_id, action, sum(CASE WHEN action IN ('warn', 'block') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e), n AS (SELECT user_id, run, sum(CASE WHEN action IN ('warn', 'block') THEN 0 ELSE 1 END) AS n FROM r GROUP BY ALL)"


def _feedback(t):
    """Feedback rows from labels: two lines for every third document."""
    d = t("labels").select("doc_id", "quality", "toxic", F.explode(F.expr("CASE WHEN doc_id % 3 = 0 THEN array(0, 1) ELSE array(0) END")).alias("again"))
    return d.select(
        F.md5(F.col("doc_id").cast("string")).alias("text_hash"), (F.col("doc_id") * 2 + F.col("again")).alias("line"),
        F.expr("CASE WHEN quality = 1 THEN 'low' ELSE 'med' END").alias("predicted"),
        F.expr("CASE WHEN toxic = 1 THEN 'critical' WHEN again = 1 THEN 'medium' ELSE 'low' END").alias("correct"), F.expr("doc_id % 5 = 0").alias("used_for_training"))


_FB = """SELECT md5(CAST(doc_id AS VARCHAR)) AS text_hash, doc_id * 2 + again AS line, CASE WHEN quality = 1 THEN 'low' ELSE 'med' END AS predicted,
    CASE WHEN toxic = 1 THEN 'critical' WHEN again = 1 THEN 'medium' ELSE 'low' END AS correct, doc_id % 5 = 0 AS used_for_training FROM (SELECT *, unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS again FROM labels)"""
_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY line DESC) AS r FROM ({_FB})) WHERE r = 1"


def _training(t, spark):
    key = F.md5(F.col("doc_id").cast("string")).alias("text_hash")
    full = t("documents").where("doc_id % 2 = 0").select(key, F.col("doc_id").alias("line"), "text")
    preview = t("documents").where("doc_id % 7 <> 0").select(key, F.col("doc_id").alias("line"), F.substring("text", 1, 500).alias("text_preview"))
    return FB.to_training(_feedback(t), full, preview).select("text_hash", F.md5("text").alias("text_md5"), "risk")


_TRAIN = f"""SELECT text_hash, md5(x) AS text_md5, CASE correct WHEN 'critical' THEN 'high' WHEN 'medium' THEN 'med' ELSE 'low' END AS risk FROM (SELECT l.text_hash, l.correct, CASE WHEN doc_id % 2 = 0 AND text NOT SIMILAR TO '\\s*' THEN text WHEN doc_id % 7 <> 0 AND left(text, 500) NOT SIMILAR TO '\\s*' THEN left(text, 500) END AS x FROM ({_LATEST}) l JOIN documents d ON md5(CAST(d.doc_id AS VARCHAR)) = l.text_hash) WHERE x IS NOT NULL"""


def _queue(t, spark):
    p = F.expr("array(cast(doc_id % 97 + 1 AS double), cast(doc_id % 31 + 1 AS double), cast(doc_id % 11 + 1 AS double))")
    d = t("documents").select("doc_id", p.alias("w")).withColumn("probs", F.expr("transform(w, x -> x / (w[0] + w[1] + w[2]))"))
    return FB.uncertainty_queue(d, "probs", "doc_id").withColumns({"uncertainty": F.round("uncertainty", 9), "second": F.round("second", 9)})


QUERIES: dict[str, Query] = {
    "action_mix": Query(lambda t, spark: E.action_mix(events(t)).withColumn("mean_score", F.round("mean_score", 9)), f"WITH e AS ({EVENTS}), c AS (SELECT count(*) AS n, {_MIX}, round(avg(risk_score), 9) AS mean_score FROM e) SELECT *, {', '.join(f'floor(100.0::DOUBLE * n_{a} / n + 0.5)::INTEGER AS pct_{a}' for a in ('block', 'warn', 'silent'))} FROM c"),
    "score_histogram": Query(lambda t, spark: E.score_histogram(events(t)), f"SELECT least(9, risk_score // 10)::INTEGER AS bucket, count(*) AS n FROM ({EVENTS}) GROUP BY 1"),
    "hour_counts": Query(lambda t, spark: E.hour_counts(events(t)).withColumns({"load": F.round("load", 9), "heat": F.round("heat", 9)}), f"WITH e AS ({EVENTS}), h AS (SELECT hour(ts) AS hour, count(*) AS n, sum(risk_score) / 100.0::DOUBLE AS load FROM e GROUP BY 1), a AS (SELECT r.range::INTEGER AS hour, coalesce(n, 0) AS n, coalesce(load, 0) AS load FROM range(24) r LEFT JOIN h ON h.hour = r.range) SELECT hour, n, round(load, 9) AS load, round(load / greatest(max(load) OVER (), 1), 9) AS heat FROM a"),
    "daily_trend": Query(lambda t, spark: E.daily_trend(events(t)), f"WITH e AS ({EVENTS}), days AS ({_DAYS}), c AS (SELECT ts::DATE AS day, {_MIX} FROM e GROUP BY 1) SELECT day, coalesce(n_block, 0) AS n_block, coalesce(n_warn, 0) AS n_warn, coalesce(n_silent, 0) AS n_silent FROM days LEFT JOIN c USING (day)"),
    "daily_mean": Query(lambda t, spark: E.daily_mean(events(t)), f"WITH e AS ({EVENTS}), days AS ({_DAYS}), c AS (SELECT ts::DATE AS day, floor(avg(risk_score) + 0.5)::INTEGER AS mean_score FROM e GROUP BY 1) SELECT day, mean_score FROM days LEFT JOIN c USING (day)"),
    "top_classes": Query(lambda t, spark: E.top_classes(events(t), "event_type", 3), f"SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM ({EVENTS}) GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 3"),
    "streaks": Query(lambda t, spark: E.streaks(events(t), "user_id"), f"WITH e AS ({EVENTS}), {_RUNS} SELECT user_id, arg_max(n, run)::BIGINT AS current_streak, max(n)::BIGINT AS best_streak FROM n GROUP BY user_id"),
    "day_streaks": Query(lambda t, spark: E.day_streaks(events(t), "user_id"), "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, CASE WHEN coalesce(day - lag(day) OVER o, 2) >= 2 THEN 1 ELSE 0 END AS br FROM d WINDOW o AS (PARTITION BY user_id ORDER BY day)), c AS (SELECT user_id, sum(br) OVER (PARTITION BY user_id ORDER BY day) AS c FROM g), n AS (SELECT user_id, c, count(*) AS days FROM c GROUP BY ALL), l AS (SELECT user_id, arg_max(days, c) AS days FROM n GROUP BY user_id) SELECT user_id, days, (CASE WHEN days >= 100 THEN 100 WHEN days >= 50 THEN 50 WHEN days >= 25 THEN 25 WHEN days >= 10 THEN 10 WHEN days >= 5 THEN 5 ELSE 0 END)::INTEGER AS milestone FROM l"),
    "recent_events": Query(lambda t, spark: E.recent(events(t), 15).select("event_id", "action", "risk_score"), f"SELECT event_id, action, risk_score FROM ({EVENTS}) ORDER BY event_id DESC LIMIT 15"),
    "rolling_kpis": Query(lambda t, spark: E.kpis(events(t)), f"WITH e AS ({EVENTS}) SELECT count(*) AS n, {_N.format(chr(39).join(('action = ', 'block', '')))} AS n_block FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 7 DAY"),
    "persona_bands": Query(lambda t, spark: E.persona(events(t), "user_id"), f"SELECT user_id, n, n_block, (CASE WHEN 100.0::DOUBLE * n_block / n >= 30 THEN 4 WHEN 100.0::DOUBLE * n_block / n >= 15 THEN 3 WHEN 100.0::DOUBLE * n_block / n >= 5 THEN 2 WHEN n_block > 0 THEN 1 ELSE 0 END)::INTEGER AS band FROM (SELECT user_id, count(*) AS n, {_N.format(chr(39).join(('action = ', 'block', '')))} AS n_block FROM ({EVENTS}) GROUP BY 1)"),
    "risk_rollup": Query(lambda t, spark: E.risk_rollup(events(t).withColumn("risk", F.expr("CASE action WHEN 'block' THEN 'high' WHEN 'warn' THEN 'med' ELSE event_type END")), "risk"), f"SELECT CASE action WHEN 'block' THEN 'high' WHEN 'warn' THEN 'med' ELSE 'unknown' END AS risk, count(*) AS n FROM ({EVENTS}) GROUP BY 1"),
    "context_json_score": Query(lambda t, spark: t("events").select("event_id", E.context_score("props", "$.k").alias("score")), "SELECT event_id, greatest(0, least(100, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)))::INTEGER AS score FROM events"),
    "latency_percentiles": Query(lambda t, spark: t("events").groupBy("event_type").agg(*[F.round(F.expr(f"percentile(value, {q})"), 9).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]), "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY 1"),
    "ttl_dedupe": Query(lambda t, spark: dedupe.ttl_dedupe_batch(t("events").select("event_id", "ts", "user_id"), "ts", "user_id", 3600).select("event_id"), "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) > 3600000000"),
    "poll_changes": Query(lambda t, spark: dedupe.changed(t("conversations"), "conv_id", "turn").select("conv_id", "turn"), "SELECT conv_id, turn FROM (SELECT *, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> md5(text)"),
    "sync_batch": Query(lambda t, spark: dedupe.sync_after(t("events"), 100).select("event_id"), "SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 200"),
    "feedback_latest": Query(lambda t, spark: FB.latest(_feedback(t)).select("text_hash", "line", "correct"), f"SELECT text_hash, line, correct FROM ({_LATEST})"),
    "feedback_pending": Query(lambda t, spark: FB.pending(_feedback(t)).select("text_hash", "line"), f"SELECT text_hash, line FROM ({_FB}) WHERE NOT used_for_training AND (SELECT count(*) FROM ({_FB}) WHERE NOT used_for_training) >= 10"),
    "feedback_training": Query(_training, _TRAIN),
    "correction_counts": Query(lambda t, spark: FB.correction_counts(_feedback(t)), f"SELECT predicted || '->' || correct AS change, count(*) AS n FROM ({_FB}) GROUP BY 1"),
    "feedback_stats": Query(lambda t, spark: FB.stats(_feedback(t)), f"SELECT count(*) AS total, {_N.format('NOT used_for_training')} AS pending, {_N.format('used_for_training')} AS used FROM ({_FB})"),
    "uncertainty_topk": Query(_queue, "WITH d AS (SELECT doc_id, (doc_id % 97 + 1)::DOUBLE AS a, (doc_id % 31 + 1)::DOUBLE AS b, (doc_id % 11 + 1)::DOUBLE AS c FROM documents), p AS (SELECT doc_id, list_reverse_sort([a / (a + b + c), b / (a + b + c), c / (a + b + c)]) AS p FROM d) SELECT doc_id, round(1 - p[1], 9) AS uncertainty, round(p[2], 9) AS second FROM p ORDER BY 1 - p[1] DESC, doc_id LIMIT 200"),
}
