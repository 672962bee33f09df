"""Curves of configurations in one scan, and what only rules or only the model see."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions.dialect import CHECK
from textwarden.functions.patterns import STRONG
from textwarden.operators import evaluate
from textwarden.plans.common import SCORED, Query, dealt, scored_labels
from textwarden.plans.data_queries import _COUNT, _metrics, _rounded, _sql_rounded

_KEPT = ("accuracy", "precision", "recall", "f1", "accuracy_gain")
_HIT = "(doc_id % 4 = 0 OR doc_id % 9 = 0)"


def _curves(t, spark):
    d = evaluate.configuration_curves(scored_labels(t), "y", "p", F.expr("doc_id % 4 = 0"), F.expr("doc_id % 9 = 0"))
    return _rounded(d, *_KEPT).select("config", "threshold", "tp", "tn", "fp", "fn", *_KEPT)


_CURVES = _sql_rounded(
    f"""WITH s AS ({SCORED}), g AS (SELECT range / 20.0::DOUBLE AS threshold FROM range(1, 20)),
    k AS (SELECT y, 'regex_ner' AS config, {_HIT}::INT::DOUBLE AS p FROM s UNION ALL SELECT y, 'ml', p FROM s UNION ALL SELECT y, 'full', 0.7::DOUBLE * p + 0.3::DOUBLE * {_HIT}::INT::DOUBLE FROM s),
    c AS (SELECT config, threshold, {_COUNT.format('y = 1 AND p >= threshold')} AS tp, {_COUNT.format('y <> 1 AND p < threshold')} AS tn, {_COUNT.format('y <> 1 AND p >= threshold')} AS fp, {_COUNT.format('y = 1 AND p < threshold')} AS fn FROM k CROSS JOIN g GROUP BY config, threshold)
    SELECT config, threshold, tp, tn, fp, fn, {', '.join(_KEPT)} FROM (SELECT *, accuracy - max(CASE WHEN config = 'regex_ner' THEN accuracy END) OVER (PARTITION BY threshold) AS accuracy_gain FROM ({_metrics()}))""",
    *_KEPT,
)


def _probe(t, spark):
    d = dealt(t("documents").select("doc_id", "text")).join(scored_labels(t), "doc_id")
    return evaluate.importance_probe(d, "doc_id", "text", "p")


_NAMES = list(dict.fromkeys(p.name for p in STRONG))
_FOUND = {n: " + ".join(CHECK.count("x", p.test) for p in STRONG if p.name == n) for n in _NAMES}
_PROBED = f"""SELECT doc_id, ({' + '.join(_FOUND.values())})::BIGINT AS regex_matches, {CHECK.present([f"CASE WHEN {f} > 0 THEN {CHECK.q(n)} END" for n, f in _FOUND.items()])} AS types, p
    FROM (SELECT doc_id, {CHECK.ascii_bounds("coalesce(text, '')")} AS x, p FROM documents JOIN ({SCORED}) USING (doc_id))"""
_TAUS = ", ".join(f"CASE WHEN p >= {t} THEN 'risky' ELSE 'safe' END AS tau_{int(100 * t):02d}" for t in (0.10, 0.45, 0.65))
_SUMMARY = " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, {_COUNT.format(f'regex_matches > 0 AND p >= {t}')} AS both_see, {_COUNT.format(f'regex_matches > 0 AND p < {t}')} AS rules_only, {_COUNT.format(f'regex_matches = 0 AND p >= {t}')} AS model_only, {_COUNT.format(f'regex_matches = 0 AND p < {t}')} AS neither FROM p"
    for t in (0.10, 0.45, 0.65)
)

QUERIES = {
    "configuration_curves": Query(_curves, _CURVES),
    "importance_probe": Query(lambda t, spark: _probe(t, spark).withColumn("regex_types", F.array_join("regex_types", "|")), f"SELECT doc_id, regex_matches, array_to_string(types, '|') AS regex_types, p, {_TAUS} FROM ({_PROBED})"),
    "importance_summary": Query(lambda t, spark: evaluate.probe_summary(_probe(t, spark)).withColumnRenamed("both", "both_see"), f"WITH p AS ({_PROBED}) {_SUMMARY}"),
}
