"""Queries on the three layers, the plain score, entities, spans and feedback. Models and taggers are stood in for by numbers made from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions import hipaa
from textwarden.functions import patterns as P
from textwarden.functions import text as X
from textwarden.functions.dialect import CHECK, SPARK, Dialect, apply, nest
from textwarden.operators import feedback, layers, mining, policy, spans
from textwarden.plans.common import Query, dealt

_MADE = "doc_id, text, doc_id * 37 % 101 AS ml, doc_id % 5 = 0 AS person"
_SRC = f"(SELECT {_MADE} FROM documents)"


def _documents(t, made: str = _MADE):
    return dealt(t("documents").select("doc_id", "text")).selectExpr(*[x.strip() for x in made.split(", ")])


def _three(d: Dialect):
    crit, med = ("(" + " OR ".join(d.rx("text", P.DEMO[n]) for n in names) + ")" for names in (P.DEMO_CRITICAL, P.DEMO_MEDIUM))
    return [
        {"lowered": "lower(text)", "crit": crit, "med": med, "said": "CASE WHEN ml >= 45 THEN 'risky' ELSE 'safe' END"},
        layers.three_layers(d, "lowered", "crit", "med", "person", "said", "ml"),
    ]


_NINE = {"O": "p0", **{k: f"p{i + 1}" for i, k in enumerate(X.PLAIN_LABEL_RISK)}}
_NINE_MADE = "doc_id, text, " + ", ".join(f"cast((doc_id * {7 + 4 * i} + {i * 13}) % {29 + 2 * i} + 1 AS double) AS w{i}" for i in range(9))
_NINE_SUM = " + ".join(f"w{i}" for i in range(9))
_PLAIN = ("doc_id", "risk", "n_classes", "action", "decision", "scalar")


def _plain(kind: str) -> Query:
    probs = {"nine": _NINE, "three": {"low": "p0", "med": "p1", "high": "p2"}, "two": {"safe": "p0", "risky": "p1"}}[kind]
    risk_of = {"O": "low", **X.PLAIN_LABEL_RISK} if kind == "nine" else None
    total = _NINE_SUM if kind == "nine" else "w0 + w1 + w2" if kind == "three" else "w0 + w1"
    limits = policy.Policy().block_prob

    def levels(d):
        return [{f"p{i}": f"w{i} / ({total})" for i in range(len(probs))}, *layers.plain_levels(d, layers.plain_probs(probs, risk_of, limits))]

    def run(t, spark):
        out = apply(_documents(t, _NINE_MADE), levels(SPARK))
        return out.selectExpr("doc_id", "risk", "cast(n_classes AS bigint) AS n_classes", "action", "decision", "cast(scalar AS bigint) AS scalar", "round(prob_low, 9) AS prob_low", "round(prob_high, 9) AS prob_high", "round(top_prob, 9) AS top_prob")

    return Query(run, f"SELECT doc_id, risk, n_classes::BIGINT AS n_classes, action, decision, scalar::BIGINT AS scalar, round(prob_low, 9) AS prob_low, round(prob_high, 9) AS prob_high, round(top_prob, 9) AS top_prob FROM ({nest(f'(SELECT {_NINE_MADE} FROM documents)', levels(CHECK))})")


def _beside(d: Dialect):
    null = "cast(NULL AS string)" if d.spark else "NULL"
    pick = lambda names, m: d.present([f"CASE WHEN doc_id % {m + i} = 0 THEN {d.q(n)} ELSE {null} END" for i, n in enumerate(names)])
    return [
        {"trig": pick(("SSN pattern", " Email Address", "IBAN", ""), 2), "cls": pick(("email address", "ssn pattern ", "phone number"), 3)},
        {"left_over": d.join(layers.triggers_beside(d, "trig", "cls"), "|")},
    ]


_LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "MONEY", "CARDINAL", "FAC", "WORK_OF_ART")


def _entities(d: Dialect):
    label = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_LABELS)) + " END"
    return [{"label": label}, {"shown": layers.entity_type(d, "label"), "counted": layers.entity_class("label"), "act": layers.ui_action("CASE event_id % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'warn' WHEN 2 THEN 'allow' END", "event_id % 7 = 0"), "mock": layers.mock_replacement(d, "CASE WHEN event_id % 2 = 0 THEN '123456789' ELSE 'x23456789' END")}, {"back": layers.action_decision("act")}]


_ENT = ("event_id", "shown", "counted", "act", "back", "mock")


def _sentences():
    def run(t, spark):
        d = dealt(t("documents").select("doc_id", "text"))
        return d.selectExpr("doc_id", f"explode({mining.sentence_spans(SPARK, 'text')}) AS s").selectExpr("doc_id", "cast(s.start AS bigint) AS start_at", "md5(s.match) AS match_md5")

    return Query(run, f"SELECT doc_id, s.start::BIGINT AS start_at, md5(s.match) AS match_md5 FROM (SELECT doc_id, unnest({mining.sentence_spans(CHECK, 'text')}) AS s FROM documents)")


#: Two made-up spans of each text: one whose offsets are off by one, one that fits; and the second once more.
_SPANS = "array(named_struct('start', 2, 'end', 6, 'class', 'A', 'match', substring(text, 2, 4), 'source', 'regex', 'risk', 'med'), named_struct('start', 10, 'end', 15, 'class', 'B', 'match', substring(text, 11, 5), 'source', 'kb_rule', 'risk', 'high'))"
_EXTRA = "array(named_struct('start', 10, 'end', 15, 'class', 'B', 'match', substring(text, 11, 5), 'source', 'model_window', 'risk', 'high'))"
_SHIFTED = "instr(text, substring(text, 2, 4)) - 1"


def _merged(t, spark):
    d = _documents(t).where("length(text) > 40").selectExpr("doc_id", "text", f"cast({_SPANS} AS array<{spans.SPAN}>) AS a", f"cast({_EXTRA} AS array<{spans.SPAN}>) AS b")
    d = d.selectExpr("doc_id", f"{spans.shift(layers.merged_spans('text', 'a', 'b'), '100')} AS s")
    return d.selectExpr("doc_id", "cast(size(s) AS bigint) AS n", "cast(aggregate(s, 0, (x, e) -> x + e.start) AS bigint) AS start_sum", "cast(aggregate(s, 0, (x, e) -> x + e.end) AS bigint) AS end_sum", "concat_ws('', s.class) AS classes")


_MERGED = f"""WITH d AS (SELECT doc_id, text, substring(text, 3, 4) = substring(text, 2, 4) AS fits, {_SHIFTED} AS pos FROM documents WHERE length(text) > 40), e AS (SELECT doc_id, CASE WHEN fits THEN 2 ELSE pos END AS pos FROM d)
    SELECT doc_id, 2::BIGINT AS n, (pos + 10 + 200)::BIGINT AS start_sum, (pos + 4 + 15 + 200)::BIGINT AS end_sum, 'AB' AS classes FROM e"""


def _feedback(t, spark):
    d = t("documents").selectExpr("doc_id", "text", "'low' AS predicted", "CASE WHEN doc_id % 3 = 0 THEN 'critical' ELSE 'medium' END AS correct", "cast(doc_id AS string) AS at")
    rows, previews, full = feedback.record(d)
    return rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.max("correct").alias("correct")).join(previews.distinct(), "text_hash").join(full.distinct(), "text_hash").selectExpr("text_hash", "n", "correct", "md5(text_preview) AS preview_md5", "md5(text) AS text_md5")


def _exports(t, spark):
    d = t("documents")
    one = d.where("doc_id % 2 = 0").selectExpr("text", "CASE doc_id % 4 WHEN 0 THEN 'critical' ELSE 'odd' END AS risk")
    two = d.where("doc_id % 2 = 1").selectExpr("'' AS text", "text AS content", "CASE WHEN doc_id % 3 = 0 THEN 'medium' END AS label")
    return feedback.export_rows(one, two).groupBy("merge_source", "risk").agg(F.count(F.lit(1)).alias("n"))


def _corrections(t, spark):
    d = t("documents").where("length(text) BETWEEN 40 AND 900").selectExpr("doc_id", "text", "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS corrected_risk", "array(named_struct('start', 5, 'end', 9, 'correct_class', CASE doc_id % 2 WHEN 0 THEN 'health' ELSE 'NAME' END)) AS span_fixes")
    return feedback.correction_rows(d).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


_CORRECTIONS = f"""WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS r, CASE doc_id % 2 WHEN 0 THEN 'high' ELSE 'med' END AS s FROM documents WHERE length(text) BETWEEN 40 AND 900),
    a AS (SELECT text, r AS risk FROM d UNION ALL SELECT substring(text, 1, 9 + 96) AS text, s AS risk FROM d), f AS (SELECT DISTINCT {X.fingerprint(CHECK, 'text')} AS f, risk FROM a WHERE length(text) BETWEEN 20 AND 1000)
    SELECT risk, count(*) AS n FROM f GROUP BY risk"""

_COVERAGE = "WITH s AS (SELECT " + ", ".join(f"coalesce(sum(({hipaa.found(CHECK, 'text', i)})::INT), 0)::BIGINT AS n{i}" for i, _, _ in hipaa.SAFE_HARBOR) + " FROM documents) " + " UNION ALL ".join(f"SELECT {i} AS id, '{c}' AS coverage, n{i} AS n FROM s" for i, _, c in hipaa.SAFE_HARBOR)

QUERIES: dict[str, Query] = {
    "three_layer_decision": Query(lambda t, spark: apply(_documents(t), _three(SPARK)).select("doc_id", "layer_decision", "layer_severity", "layer_reason"), f"SELECT doc_id, layer_decision, layer_severity, layer_reason FROM ({nest(_SRC, _three(CHECK))})"),
    "plain_score_nine": _plain("nine"),
    "plain_score_three": _plain("three"),
    "plain_score_two": _plain("two"),
    "triggers_beside_spans": Query(lambda t, spark: apply(t("documents").select("doc_id"), _beside(SPARK)).select("doc_id", "left_over"), f"SELECT doc_id, left_over FROM ({nest('(SELECT doc_id FROM documents)', _beside(CHECK))})"),
    "entity_types": Query(lambda t, spark: apply(t("events").select("event_id"), _entities(SPARK)).select(*_ENT), f"SELECT {', '.join(_ENT)} FROM ({nest('(SELECT event_id FROM events)', _entities(CHECK))})"),
    "hipaa_coverage": Query(lambda t, spark: hipaa.coverage_counts(_documents(t)), _COVERAGE),
    "sentence_spans": _sentences(),
    "merged_spans": Query(_merged, _MERGED),
    "feedback_record": Query(_feedback, "SELECT sha256(text) AS text_hash, count(*) AS n, max(CASE WHEN doc_id % 3 = 0 THEN 'critical' ELSE 'medium' END) AS correct, md5(left(any_value(text), 500)) AS preview_md5, md5(any_value(text)) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)"),
    "feedback_exports": Query(_exports, "SELECT merge_source, risk, count(*) AS n FROM (SELECT CASE doc_id % 2 WHEN 0 THEN 'bubble_export' ELSE 'span_export' END AS merge_source, CASE WHEN doc_id % 4 = 0 THEN 'high' WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'med' END AS risk, text FROM documents) WHERE trim(text) <> '' AND risk IS NOT NULL GROUP BY 1, 2"),
    "span_corrections": Query(_corrections, _CORRECTIONS),
    "layer_counts": Query(lambda t, spark: layers.layer_counts(_documents(t).selectExpr("*", "text RLIKE '@' AS r", "ml >= 45 AS m", "doc_id % 2 = 0 AS y"), "r", "person", "m", "y"), f"SELECT sum(r::INT)::BIGINT AS regex_hits, sum(person::INT)::BIGINT AS name_hits, sum((r OR person)::INT)::BIGINT AS union_hits, sum((doc_id % 2 = 0 AND NOT (r OR person))::INT)::BIGINT AS missed, bool_and((ml >= 45) = (r OR person)) AS same_as_union, count(*) AS total FROM (SELECT *, contains(text, '@') AS r FROM {_SRC})"),
}
