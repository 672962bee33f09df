"""Queries on curation, evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions import text as X
from textwarden.functions.dialect import CHECK, SPARK
from textwarden.operators import curate, evaluate
from textwarden.plans.common import SCORED, Query, dealt, scored_labels

DRAW = "md5('42|' || CAST(doc_id AS VARCHAR))"
#: The deterministic split that overlap queries use: by the last digit of the id.
SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'validation' ELSE 'test' END"
HELD = ("src1", "src3")
CAPS = {"en": 50, "fr": 30, "de": 20}


def _metrics(tp: str = "tp", tn: str = "tn", fp: str = "fp", fn: str = "fn") -> str:
    r = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
    return f"""SELECT *, {r('2 * precision * recall', '(precision + recall)')} AS f1, {r('5 * precision * recall', '(4 * precision + recall)')} AS f2, {r('fn', '(tp + fn)')} AS fnr, {r('tn', '(tn + fp)')} AS specificity,
    {r('(tp * tn - fp * fn)::DOUBLE', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc FROM (SELECT *, {r('tp + tn', '(tp + tn + fp + fn)')} AS accuracy, {r('tp', '(tp + fp)')} AS precision, {r('tp', '(tp + fn)')} AS recall, {r('fp', '(fp + tn)')} AS fpr FROM c)"""


_COUNT = "sum(CASE WHEN {} THEN 1 ELSE 0 END)::BIGINT"
_AT = f"SELECT threshold, {_COUNT.format('y = 1 AND p >= threshold')} AS tp, {_COUNT.format('y <> 1 AND p < threshold')} AS tn, {_COUNT.format('y <> 1 AND p >= threshold')} AS fp, {_COUNT.format('y = 1 AND p < threshold')} AS fn FROM s CROSS JOIN g GROUP BY threshold"
_GRID = "SELECT range / 100.0::DOUBLE AS threshold FROM range(10, 91, 5)"
_SWEEP = f"WITH s AS ({SCORED}), g AS ({_GRID}), c AS ({_AT}) {_metrics()}"
_ROUND = ("accuracy", "precision", "recall", "fpr", "f1", "f2", "fnr", "specificity", "mcc")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _sql_rounded(sql: str, *cols: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in cols)}) FROM ({sql})"


#: Documents that stand for a corpus of their own, with near copies among the others.
PART = "doc_id % 40 = 0"


def _near_dup_sql(corpus: str = "benchmark", rows: str = "true") -> str:
    a = f"SELECT doc_id, {X.token_set(CHECK, 'text')} AS s FROM documents WHERE {rows}"
    b = f"SELECT item_id, {X.token_set(CHECK, 'text')} AS s FROM {corpus}"
    return f"SELECT doc_id, item_id, round(j, 9) AS jaccard FROM (SELECT doc_id, item_id, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS j FROM ({a}) a CROSS JOIN ({b}) b WHERE len(a.s) > 0 AND len(b.s) > 0) WHERE j >= 0.62"


def _split_sql() -> str:
    return f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY {DRAW}, doc_id) AS place, count(*) OVER (PARTITION BY coalesce(lang, '')) AS n FROM documents)
    SELECT doc_id, CASE WHEN place <= round(n * 0.70::DOUBLE) THEN 'train' WHEN place <= round(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM d"""


def _with_split(t):
    return t("documents").withColumn("split", F.expr(SPLIT))


def _two_sql() -> str:
    r = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
    return f"""WITH s AS ({SCORED}), pr AS (SELECT 0.35::DOUBLE + i * (0.57::DOUBLE / 23) AS t_block, i, j FROM range(24) a(i) CROSS JOIN range(18) b(j)),
    q AS (SELECT *, 0.05::DOUBLE + j * ((t_block - 0.10::DOUBLE) / 17) AS t_warn FROM pr),
    c AS (SELECT i, j, t_block, t_warn, {_COUNT.format('y = 1 AND p >= t_block')} AS tpb, {_COUNT.format('y <> 1 AND p >= t_block')} AS fpb, {_COUNT.format('y = 1')} AS np, {_COUNT.format('y <> 1')} AS nn, {_COUNT.format('y = 1 AND p >= t_warn')} AS tpa, {_COUNT.format('y <> 1 AND p >= t_warn')} AS fpa FROM s CROSS JOIN q GROUP BY ALL),
    m AS (SELECT *, {r('tpb', 'np')} AS block_recall, {r('tpb', '(tpb + fpb)')} AS block_precision, {r('fpb', 'nn')} AS block_fpr, tpa - tpb AS warn_tp, fpa - fpb AS warn_fp, {r('tpa - tpb', '(tpa - tpb + fpa - fpb)')} AS warn_precision, {r('tpa', 'np')} AS combined_recall, {r('fpa', 'nn')} AS combined_fpr FROM c)
    SELECT round(t_warn, 9) AS t_warn, round(t_block, 9) AS t_block, round(block_recall, 9) AS block_recall, warn_tp, warn_fp, round(score, 9) AS score FROM (SELECT *, 10 * block_recall + 3 * combined_recall + 2 * block_precision + warn_precision - 5 * block_fpr - 2 * combined_fpr AS score FROM m WHERE block_fpr <= 0.5 AND block_recall >= 0.5 AND combined_fpr <= 0.6 AND combined_recall >= 0.60) ORDER BY score DESC, i, j LIMIT 1"""


def _two(t, spark):
    out = evaluate.best_two_thresholds(scored_labels(t), spark, "y", "p", max_fpr_block=0.5, max_fpr_warn=0.6, min_recall_block=0.5)
    return _rounded(out, "t_warn", "t_block", "block_recall", "score").select("t_warn", "t_block", "block_recall", "warn_tp", "warn_fp", "score")


_HIST = f"SELECT p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM ({SCORED}) GROUP BY p"
_CURVE = f"""WITH h AS ({_HIST}), u AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM h),
    v AS (SELECT p, tp::BIGINT AS tp, fp::BIGINT AS fp, tp::DOUBLE / (tp + fp) AS precision, CASE WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END AS recall, CASE WHEN nn = 0 THEN 0 ELSE fp::DOUBLE / nn END AS fpr FROM u)"""
_CLS = "CASE WHEN {0} >= 0.6 THEN 'high' WHEN {0} >= 0.3 THEN 'med' ELSE 'low' END"
_TRUTH = "CASE WHEN y = 1 THEN 'high' WHEN doc_id % 3 = 0 THEN 'med' ELSE 'low' END"


def _classes(t):
    return scored_labels(t).selectExpr("doc_id", "y", "p", f"{_TRUTH} AS truth", f"{_CLS.format('p')} AS z")


_CLASSES = f"SELECT doc_id, y, p, {_TRUTH} AS truth, {_CLS.format('p')} AS z FROM ({SCORED})"
_F = "CASE WHEN {0} + {1} = 0 THEN 0 ELSE 2 * {0} * {1} / ({0} + {1}) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


def _dedupe_sql(key: str, where: str = "true") -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS r FROM documents WHERE {where}) WHERE r = 1"


QUERIES: dict[str, Query] = {
    "fingerprint_dedupe": Query(lambda t, spark: curate.fingerprint_dedupe(t("documents"), "doc_id").select("doc_id"), _dedupe_sql(X.fingerprint(CHECK, "text"), "length(text) BETWEEN 20 AND 1000")),
    "exact_dedupe": Query(lambda t, spark: curate.exact_dedupe(t("documents"), "doc_id").select("doc_id"), _dedupe_sql("md5(text)")),
    "audit_duplicates": Query(lambda t, spark: curate.audit(t("documents")), f"SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY {X.audit_key(CHECK, 'text')})"),
    "source_report": Query(lambda t, spark: _rounded(curate.source_report(t("documents"), label="lang"), "mean_chars"), "SELECT source, count(*) AS n_rows, count(lang) AS n_labelled, round(avg(length(text)), 9) AS mean_chars FROM documents GROUP BY source"),
    "source_holdout": Query(lambda t, spark: t("documents").groupBy(F.when(F.col("source").isin(*HELD), "test").otherwise("train").alias("part")).agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN source IN {HELD} THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM documents GROUP BY 1"),
    "split_overlap_matrix": Query(lambda t, spark: _rounded(curate.overlap_matrix(_with_split(t)), "share_left", "share_right"), f"""WITH h AS (SELECT DISTINCT {X.audit_key(CHECK, 'text')} AS h, {SPLIT} AS s FROM documents), p AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(left_split, right_split))
        SELECT left_split, right_split, n_both, round(n_both / nl, 9) AS share_left, round(n_both / nr, 9) AS share_right FROM (SELECT left_split, right_split, (SELECT count(*) FROM h a JOIN h b USING (h) WHERE a.s = left_split AND b.s = right_split) AS n_both, (SELECT count(*) FROM h WHERE s = left_split) AS nl, (SELECT count(*) FROM h WHERE s = right_split) AS nr FROM p)"""),
    "leakage_rate": Query(lambda t, spark: _rounded(curate.leakage(_with_split(t).where("split = 'train'"), _with_split(t).where("split = 'validation'")), "share"), f"WITH d AS (SELECT md5(text) AS h, {SPLIT} AS s FROM documents), v AS (SELECT h IN (SELECT h FROM d WHERE s = 'train') AS hit FROM d WHERE s = 'validation') SELECT sum(hit::INT)::BIGINT AS leaked, count(*) AS rows, round(avg(hit::INT), 9) AS share, avg(hit::INT) > 0.05 AS too_large FROM v"),
    "near_dup_vs_benchmark": Query(lambda t, spark: _rounded(curate.near_duplicates(dealt(t("documents").select("doc_id", "text")), t("benchmark"), "doc_id", "item_id"), "jaccard"), _near_dup_sql()),
    "near_dup_vs_documents": Query(lambda t, spark: _rounded(curate.near_duplicates(dealt(t("documents").select("doc_id", "text")).where(f"NOT {PART}"), t("documents").where(PART).selectExpr("doc_id AS item_id", "text"), "doc_id", "item_id"), "jaccard"), _near_dup_sql(f"(SELECT doc_id AS item_id, text FROM documents WHERE {PART})", f"NOT {PART}")),
    "stratified_split": Query(lambda t, spark: curate.stratified_split(t("documents"), "doc_id", "lang").select("doc_id", "split"), _split_sql()),
    "cap_per_class": Query(lambda t, spark: curate.cap_per_class(t("documents"), "doc_id", "lang", CAPS).select("doc_id", "lang"), f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DRAW}, doc_id) AS r FROM documents) WHERE r <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items())} ELSE 0 END"),
    "oversample_to_max": Query(lambda t, spark: curate.oversample(t("documents").select("doc_id", "lang"), "doc_id", "lang").groupBy("lang", "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum")), f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DRAW}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL), m AS (SELECT max(n) AS t FROM d)
        SELECT lang, copy::INTEGER AS copy, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM (SELECT lang, doc_id, unnest(range(0, ((t - r - 1) // n) + 1)) AS copy FROM d CROSS JOIN m) GROUP BY ALL"""),
    "class_weights": Query(lambda t, spark: _rounded(curate.class_weights(t("documents"), "lang"), "weight"), "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT *, (sum(n) OVER ())::DOUBLE / ((count(*) OVER ()) * n) AS raw FROM c) SELECT lang, n, round(raw / avg(raw) OVER (), 9) AS weight FROM r"),
    "confusion_at_threshold": Query(lambda t, spark: _rounded(evaluate.with_metrics(evaluate.confusion(scored_labels(t), "y", F.col("p") >= 0.45)), *_ROUND), _sql_rounded(f"WITH s AS ({SCORED}), g AS (SELECT 0.45::DOUBLE AS threshold), c AS (SELECT * EXCLUDE (threshold) FROM ({_AT})) {_metrics()}", *_ROUND)),
    "threshold_sweep": Query(lambda t, spark: _rounded(evaluate.sweep(scored_labels(t), evaluate.grid(spark, 10, 90, 5), "y", "p"), *_ROUND), _sql_rounded(_SWEEP, *_ROUND)),
    "best_threshold": Query(lambda t, spark: _rounded(evaluate.best_threshold(evaluate.sweep(scored_labels(t), evaluate.grid(spark, 10, 90, 5), "y", "p")), *_ROUND), _sql_rounded(f"SELECT * FROM ({_SWEEP}) ORDER BY fpr <= 0.10 DESC, recall DESC, precision DESC, f1 DESC, threshold DESC LIMIT 1", *_ROUND)),
    "two_threshold_sweep": Query(_two, _two_sql()),
    "three_class_sweep": Query(lambda t, spark: _rounded(evaluate.best_three_class(scored_labels(t).selectExpr("CASE WHEN y = 1 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS c", "p", "round(1 - p, 3) AS q"), spark, "c", "p", "q"), "t_high", "t_med", "recall_high", "recall_med", "fpr")),
    "pr_curve": Query(lambda t, spark: _rounded(evaluate.pr_curve(scored_labels(t), "y", "p"), "precision", "recall", "fpr"), _CURVE + " SELECT p, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM v"),
    "curve_areas": Query(lambda t, spark: _rounded(evaluate.areas(scored_labels(t), "y", "p"), "roc_auc", "auprc", "average_precision"), _CURVE + ", w AS (SELECT *, coalesce(lag(fpr) OVER o, 0) AS f0, coalesce(lag(recall) OVER o, 0) AS r0, coalesce(lag(precision) OVER o, 1) AS p0 FROM v WINDOW o AS (ORDER BY p DESC)) SELECT round(sum((fpr - f0) * (recall + r0) / 2), 9) AS roc_auc, round(sum((recall - r0) * (precision + p0) / 2), 9) AS auprc, round(sum((recall - r0) * precision), 9) AS average_precision FROM w"),
    "curve_resample": Query(lambda t, spark: _rounded(evaluate.resample(evaluate.pr_curve(scored_labels(t), "y", "p"), "recall", "precision"), "recall", "precision")),
    "curve_downsample": Query(lambda t, spark: evaluate.downsample(evaluate.pr_curve(scored_labels(t), "y", "p"), "p").select("p", "tp", "fp"), _CURVE + ", w AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM v) SELECT p, tp, fp FROM w WHERE n <= 96 OR i IN (SELECT round_even(k * (SELECT max(n) - 1 FROM w) / 95.0::DOUBLE, 0)::BIGINT FROM range(96) r(k))"),
    "per_class_prf": Query(lambda t, spark: _rounded(evaluate.per_class(_classes(t), "truth", "z"), "precision", "recall", "f1"), _sql_rounded(f"""WITH d AS ({_CLASSES}), k AS (SELECT DISTINCT truth AS class FROM d UNION SELECT DISTINCT z FROM d), c AS (SELECT class, {_COUNT.format('truth = class AND z = class')} AS tp, {_COUNT.format('truth <> class AND z = class')} AS fp, {_COUNT.format('truth = class AND z <> class')} AS fn FROM d CROSS JOIN k GROUP BY class),
        m AS (SELECT *, {_ratio('tp', '(tp + fp)')} AS precision, {_ratio('tp', '(tp + fn)')} AS recall FROM c) SELECT *, {_F.format('precision', 'recall')} AS f1 FROM m""", "precision", "recall", "f1")),
    "per_category_prf": Query(lambda t, spark: _rounded(evaluate.per_category(scored_labels(t).withColumn("cat", F.concat(F.lit("c"), F.expr("doc_id % 4"))), "cat", "y", F.col("p") >= 0.45), "precision", "recall", "f1"), _sql_rounded(f"""WITH d AS (SELECT *, 'c' || (doc_id % 4) AS cat FROM ({SCORED})), n AS (SELECT {_COUNT.format('p >= 0.45')} AS fp FROM d WHERE y = 0), c AS (SELECT cat, {_COUNT.format('p >= 0.45')} AS tp, {_COUNT.format('NOT p >= 0.45')} AS fn FROM d WHERE y = 1 GROUP BY cat),
        m AS (SELECT cat, tp, fp, fn, {_ratio('tp', '(tp + fp)')} AS precision, {_ratio('tp', '(tp + fn)')} AS recall FROM c CROSS JOIN n) SELECT *, {_F.format('precision', 'recall')} AS f1 FROM m""", "precision", "recall", "f1")),
    "safety_profile": Query(lambda t, spark: _rounded(evaluate.safety_profile(_classes(t), "truth", "z"), "miss_rate", "false_alarm_rate"), _sql_rounded(f"WITH d AS ({_CLASSES}), c AS (SELECT {_COUNT.format(chr(39).join(('truth = ', 'high', ' AND z = ', 'low', '')))} AS high_to_low, {_COUNT.format(chr(39).join(('truth = ', 'high', ' AND z = ', 'med', '')))} AS high_to_med, {_COUNT.format(chr(39).join(('truth <> ', 'high', ' AND z = ', 'high', '')))} AS other_to_high, {_COUNT.format(chr(39).join(('truth = ', 'high', '')))} AS n_high, {_COUNT.format(chr(39).join(('truth <> ', 'high', '')))} AS n_other FROM d) SELECT *, {_ratio('high_to_low + high_to_med', 'n_high')} AS miss_rate, {_ratio('other_to_high', 'n_other')} AS false_alarm_rate FROM c", "miss_rate", "false_alarm_rate")),
    "mcnemar": Query(lambda t, spark: _rounded(evaluate.mcnemar(scored_labels(t), "y", F.col("p") >= 0.3, F.col("p") >= 0.5), "chi2"), _sql_rounded(f"WITH d AS (SELECT (p >= 0.3) = (y = 1) AS a, (p >= 0.5) = (y = 1) AS b FROM ({SCORED})), c AS (SELECT {_COUNT.format('a AND b')} AS both_right, {_COUNT.format('a AND NOT b')} AS only_a, {_COUNT.format('NOT a AND b')} AS only_b, {_COUNT.format('NOT a AND NOT b')} AS both_wrong FROM d) SELECT *, {_ratio('(abs(only_a - only_b) - 1)::DOUBLE * (abs(only_a - only_b) - 1)', '(only_a + only_b)')} AS chi2 FROM c", "chi2")),
    "zone_distribution": Query(lambda t, spark: evaluate.zones(scored_labels(t), "y", "p", 0.2, 0.45), f"SELECT CASE WHEN p >= 0.45 THEN 'block' WHEN p >= 0.2 THEN 'warn' ELSE 'safe' END AS zone, y AS label, count(*) AS n FROM ({SCORED}) GROUP BY 1, 2"),
    "gate_metrics": Query(lambda t, spark: evaluate.gate(_classes(t).selectExpr("CASE truth WHEN 'high' THEN 'risky' WHEN 'med' THEN 'med' ELSE 'safe' END AS l", "CASE truth WHEN 'high' THEN 'block' WHEN 'med' THEN 'warn' ELSE 'silent' END AS e", "CASE z WHEN 'high' THEN 'block' WHEN 'med' THEN 'warn' ELSE 'silent' END AS a"), "l", "e", "a")),
    "benign_profile": Query(lambda t, spark: _rounded(evaluate.benign_profile(scored_labels(t), "y", "p"), "p50", "p75", "p90", "p95", "p99", "max", "mean", *[f"fpr_{k}0" for k in range(1, 9)]), f"SELECT {', '.join(f'round(quantile_cont(p, {q}), 9) AS p{int(q * 100)}' for q in (0.5, 0.75, 0.9, 0.95, 0.99))}, round(max(p), 9) AS max, round(avg(p), 9) AS mean, {', '.join(f'round(avg(CASE WHEN p >= 0.{k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS fpr_{k}0' for k in range(1, 9))} FROM ({SCORED}) WHERE y = 0"),
}
