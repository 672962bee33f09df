"""Queries on the loaders' label rules, on evaluation reports and on splits, over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions.dialect import CHECK
from textwarden.functions.patterns import STRONG
from textwarden.operators import curate, evaluate, spans
from textwarden.plans.common import SCORED, Query, scored_labels
from textwarden.plans.data_queries import _AT, _CLASSES, _CURVE, DRAW, SPLIT, _classes, _rounded, _sql_rounded
from textwarden.sources import readers

#: Written out apart from the readers' tables.
_RISK = "CASE lower(trim({0})) WHEN 'public' THEN 'low' WHEN 'internal' THEN 'low' WHEN 'low' THEN 'low' WHEN 'confidential' THEN 'med' WHEN 'medium' THEN 'med' WHEN 'med' THEN 'med' WHEN 'restricted' THEN 'high' WHEN 'sensitive' THEN 'high' WHEN 'high' THEN 'high' ELSE 'med' END"
_SENS = "CASE doc_id % 7 WHEN 0 THEN 'Public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN ' RESTRICTED ' WHEN 4 THEN 'sensitive' WHEN 5 THEN 'odd' END"
_LAB = "CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' END"
_BOTH = f"doc_id, text, {_SENS} AS sensitivity, {_LAB} AS label"


def _labels(corpus: str, first: str, then: str, without: str) -> Query:
    def run(t, spark):
        d = t("documents").where("length(text) > 0").selectExpr("text", f"{_SENS} AS sensitivity", f"{_LAB} AS label")
        return readers.labelled(d, corpus).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))

    picked = f"coalesce({first}, {then})"
    return Query(run, f"SELECT risk, count(*) AS n FROM (SELECT CASE WHEN {picked} IS NULL THEN {without} ELSE {_RISK.format(picked)} END AS risk FROM (SELECT {_BOTH} FROM documents WHERE length(trim(text)) > 0)) GROUP BY risk")


_CLASS_NAMES = ("O", "NAME", "LOCATION", "CONTACT", "ID", "OTHER_PII", "FINANCIAL", "HEALTH", "AUTH")  # from the lowest priority up
_TAGS = {"NAME": "FIRSTNAME", "LOCATION": "CITY", "CONTACT": "EMAIL", "ID": "PASSPORT", "OTHER_PII": "SHOESIZE", "FINANCIAL": "IBAN", "HEALTH": "MEDICAL", "AUTH": "PASSWORD"}
_COLLAPSE = {v: k for k, v in _TAGS.items() if k != "OTHER_PII"}
_PICK = lambda i, names: f"CASE {i} " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(names)) + " END"
_TOP = f"SELECT text, list_extract([{', '.join(repr(c) for c in _CLASS_NAMES)}], (greatest(i, j) + 1)::INT) AS label FROM (SELECT *, doc_id % 9 AS i, (doc_id // 9) % 9 AS j FROM documents)"


def _masked(t, spark):
    names = ["", *[f"[{_TAGS[c]}_1]" for c in _CLASS_NAMES[1:]]]
    d = t("documents").selectExpr("text", f"concat({_PICK('doc_id % 9', names)}, ' and ', {_PICK('(doc_id div 9) % 9', names)}) AS masked", "CASE doc_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'en-GB' ELSE '' END AS language")
    return readers.masked_templates(d, "text", "masked", _COLLAPSE, "language").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _tags(t, spark):
    names = ["O", *[f"B-{_TAGS[c]}" for c in _CLASS_NAMES[1:]]]
    d = t("documents").selectExpr("split(text, ' ') AS tokens", f"array({_PICK('doc_id % 9', names)}, 'O', {_PICK('(doc_id div 9) % 9', names)}) AS tags")
    return readers.bio_tokens(d, "tokens", "tags", _COLLAPSE).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _secret(t, spark):
    d = t("documents").selectExpr("text AS code", "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_positive", "CASE doc_id % 2 WHEN 0 THEN 'MED' ELSE 'odd' END AS risk")
    hub = t("documents").selectExpr("doc_id", "text AS snippet", "CASE doc_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'leak' ELSE '0' END AS label")
    one = readers.secret_rows(d).withColumn("set", F.lit("rows"))
    return one.unionByName(readers.hub_secret_rows(hub).withColumn("set", F.lit("hub"))).groupBy("set", "risk").agg(F.count(F.lit(1)).alias("n"))


_SECRET = """SELECT "set", risk, count(*) AS n FROM (
    SELECT 'rows' AS "set", CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE CASE doc_id % 2 WHEN 0 THEN 'med' END END AS risk FROM documents WHERE trim(text) <> ''
    UNION ALL SELECT 'hub', CASE doc_id % 3 WHEN 1 THEN 'high' ELSE 'low' END FROM documents WHERE length(trim(text)) >= 8) WHERE risk IS NOT NULL GROUP BY 1, 2"""


def _balanced(t, spark):
    d = t("documents").selectExpr("text", "CASE doc_id % 4 WHEN 0 THEN 'Medium' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'odd' END AS risk")
    return readers.balanced_rows(d, 500).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def _union(t, spark):
    d = t("documents").select("doc_id", "text")
    both = curate.union_sources([("first", d.where("doc_id % 2 = 0")), ("second", d.withColumn("more", F.lit(1)))])
    return curate.first_of(both, F.md5("text"), "source_rank", "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


_UNION = """WITH u AS (SELECT doc_id, text, 0 AS k FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text, 1 FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY k, doc_id) AS r FROM u)
    SELECT CASE k WHEN 0 THEN 'first' ELSE 'second' END AS source, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM r WHERE r = 1 OR text IS NULL GROUP BY 1"""
_THREE = "CASE doc_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'med' WHEN 2 THEN 'med' ELSE 'low' END"


def _ranked(rows: str, limit: str, copies: str = "1") -> str:
    return f"SELECT label, sum({copies})::BIGINT AS n, sum(doc_id * {copies})::BIGINT AS id_sum FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {DRAW}, doc_id) AS r, count(*) OVER (PARTITION BY label) AS k FROM ({rows})) WHERE r <= {limit} GROUP BY label"


def _thirds(t, spark):
    d = t("documents").selectExpr("doc_id", f"{_THREE} AS label")
    return curate.equal_thirds(d, "doc_id", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def _halves(t, spark):
    d = t("documents").selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS label")
    return curate.binary_halves(d, "doc_id", "label", 100).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


_T = f"(SELECT count(*) FROM documents WHERE {_THREE} = 'med')"
_HITS = "email address"


def _hits(t, spark):
    d = t("documents").select("doc_id", "text")
    cand = d.where("length(text) > 0").selectExpr("doc_id", "explode(sequence(0, length(text) - 1, 200)) AS start").selectExpr("doc_id", "start", "start + 100 AS end")
    found = spans.find(d, next(p for p in STRONG if p.name == _HITS)).selectExpr("doc_id", "explode(spans) AS s").selectExpr("doc_id", "s.start", "s.end")
    return evaluate.candidate_hits(cand, found, "doc_id").groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("start_sum"))


_HITS_SQL = f"""WITH s AS (SELECT doc_id, s.start AS a, s."end" AS b FROM (SELECT doc_id, unnest({spans.offsets(CHECK, 'text', next(p for p in STRONG if p.name == _HITS).regex)}) AS s FROM documents)),
    c AS (SELECT doc_id, unnest(range(0, length(text), 200)) AS start FROM documents WHERE length(text) > 0)
    SELECT hit, count(*) AS n, sum(start)::BIGINT AS start_sum FROM (SELECT c.*, EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND c.start + 100 > s.a AND c.start < s.b) AS hit FROM c) GROUP BY hit"""
_SHORT = "trim(left(text, 24))"


def _misses(t, spark):
    return evaluate.miss_patterns(t("documents").selectExpr("CASE doc_id % 4 WHEN 0 THEN upper(left(text, 24)) WHEN 1 THEN cast(doc_id AS string) ELSE left(text, 24) END AS piece", "doc_id % 3 AS start"), "piece", "start")


_MISSES = rf"""SELECT sum((len(regexp_extract_all(p, '\S+')) < 3)::INT)::BIGINT AS short, sum(({CHECK.upper('p')} = p AND regexp_matches(p, '[A-Z]'))::INT)::BIGINT AS capitals, sum(regexp_matches(p, '^[0-9./ -]+$')::INT)::BIGINT AS numbers_only, sum((start = 0)::INT)::BIGINT AS at_start
    FROM (SELECT regexp_replace(CASE doc_id % 4 WHEN 0 THEN {CHECK.upper('left(text, 24)')} WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE left(text, 24) END, '^\s+|\s+$', '', 'g') AS p, doc_id % 3 AS start FROM documents)"""


def _errors(t, spark):
    return evaluate.errors(_classes(t), "truth", "z", "p").select("doc_id", "truth", "z", "p", "missed_high")


_R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
_F = "CASE WHEN {0} + {1} = 0 THEN 0 ELSE 2 * {0} * {1} / ({0} + {1}) END"
_SIDES = f"""m AS (SELECT *, {_R('tp', '(tp + fp)')} AS precision, {_R('tp', '(tp + fn)')} AS recall, {_R('tn', '(tn + fn)')} AS safe_precision, {_R('tn', '(tn + fp)')} AS safe_recall, {_R('fp', '(fp + tn)')} AS fpr FROM c),
    f AS (SELECT *, ({_F.format('precision', 'recall')} + {_F.format('safe_precision', 'safe_recall')}) / 2 AS macro_f1 FROM m)"""
_SIDED = ("precision", "safe_precision", "safe_recall", "macro_f1", "fpr")


def _check(t, spark):
    return _rounded(evaluate.threshold_check(scored_labels(t), spark, "y", "p"), *_SIDED).select("threshold", "place", *_SIDED)


def _sides(t, spark):
    return _rounded(evaluate.two_sided(scored_labels(t), "y", F.col("p") >= 0.45), *_SIDED).select("tp", "tn", "fp", "fn", *_SIDED)


_LOG = "SELECT event_id AS step, CASE WHEN event_id % 3 = 0 THEN round((value * 7) % 1, 6) END AS metric, CASE WHEN event_id % 2 = 0 THEN round((value * 3) % 1, 6) END AS eval_loss FROM events"


def _log(t, spark):
    return evaluate.best_and_last(t("events").selectExpr("event_id AS step", "CASE WHEN event_id % 3 = 0 THEN round((value * 7) % 1, 6) END AS metric", "CASE WHEN event_id % 2 = 0 THEN round((value * 3) % 1, 6) END AS eval_loss"), "step", "metric").select("which", "step")


def _manual(t, spark):
    d = t("documents")
    part = lambda s: d.where(f"{SPLIT} = '{s}'").select("text")
    return curate.manual_overlap(part("test"), part("train"), part("validation"))


_KEY = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


def _guard(t, spark):
    d = t("documents").selectExpr("doc_id", "source", "lang", f"{SPLIT} AS split")
    big, tiny = curate.small_corpus_guard(d.where("lang IS NOT NULL"), "split", "lang"), curate.small_corpus_guard(d.where("doc_id < 9"), "split", "lang")
    return big.withColumn("kind", F.lit("big")).unionByName(tiny.withColumn("kind", F.lit("tiny"))).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"))


_GUARD = f"""WITH d AS (SELECT doc_id, lang, {SPLIT} AS split FROM documents), c AS (SELECT count(*) AS n, min(k) AS least FROM (SELECT count(*) OVER (PARTITION BY lang) AS k FROM d WHERE lang IS NOT NULL))
    SELECT 'big' AS kind, CASE WHEN c.n < 20 OR c.least < 2 THEN 'train' ELSE split END AS split, count(*) AS n FROM d CROSS JOIN c WHERE lang IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'tiny', 'train', count(*) FROM d WHERE doc_id < 9"""


def _gate_sql() -> str:
    rows = f"SELECT CASE truth WHEN 'high' THEN 'risky' WHEN 'med' THEN 'med' ELSE 'safe' END AS l, CASE truth WHEN 'high' THEN 'block' WHEN 'med' THEN 'warn' ELSE 'silent' END AS e, CASE z WHEN 'high' THEN 'block' WHEN 'med' THEN 'warn' ELSE 'silent' END AS a FROM ({_CLASSES})"
    n = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    rates = f"SELECT count(*) AS n, {_R(n('e = a'), 'count(*)')} AS pass_rate, {_R(n(chr(39).join(('l = ', 'safe', ' AND a <> ', 'silent', ''))), n(chr(39).join(('l = ', 'safe', ''))))} AS safe_fp_rate, {_R(n(chr(39).join(('l = ', 'med', ' AND a = ', 'warn', ''))), n(chr(39).join(('l = ', 'med', ''))))} AS medium_warn_recall, {_R(n(chr(39).join(('l = ', 'risky', ' AND a = ', 'block', ''))), n(chr(39).join(('l = ', 'risky', ''))))} AS risky_block_recall FROM ({rows})"
    return f"SELECT *, CASE WHEN pass_rate >= 0.92 AND medium_warn_recall >= 0.85 AND risky_block_recall >= 0.98 AND safe_fp_rate <= 0.03 THEN 'promote_to_full' ELSE 'canary_10pct' END AS decision FROM ({rates})"


_CELL = "greatest(-1, least(36, floor(({0} - 0.05) * 40 + 1e-9)))"
_SWEEP3 = f"""WITH s AS (SELECT CASE WHEN y = 1 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS c, {_CELL.format('p')} AS h, {_CELL.format('round(1 - p, 3)')} AS m FROM ({SCORED})), g AS (SELECT i.range AS a, j.range AS b FROM range(37) i CROSS JOIN range(37) j),
    k AS (SELECT a, b, sum((h >= a AND c = 2)::INT) AS hh, sum((c = 2)::INT) AS nh, sum((h < a AND m >= b AND c = 1)::INT) AS mm, sum((c = 1)::INT) AS nm, sum((h >= a AND c <> 2)::INT) AS fh, sum((c <> 2)::INT) AS nn FROM g CROSS JOIN s GROUP BY a, b),
    r AS (SELECT a * 0.025 + 0.05 AS t_high, b * 0.025 + 0.05 AS t_med, {_R('hh', 'nh')} AS recall_high, {_R('mm', 'nm')} AS recall_med, {_R('fh', 'nn')} AS fpr FROM k)
    SELECT round(t_high::DOUBLE, 9) AS t_high, round(t_med::DOUBLE, 9) AS t_med, round(recall_high, 9) AS recall_high, round(recall_med, 9) AS recall_med, round(fpr, 9) AS fpr FROM r ORDER BY (fpr <= 0.10 AND recall_high >= 0.85 AND recall_med >= 0.35) DESC, recall_high DESC, recall_med DESC, fpr, t_high, t_med LIMIT 1"""
_RESAMPLE = _CURVE + """, b AS (SELECT recall AS x, max(precision) AS y FROM v GROUP BY recall), w AS (SELECT *, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, row_number() OVER (ORDER BY x) = 1 AS f FROM b), g AS (SELECT range / 100.0::DOUBLE AS gx FROM range(101))
    SELECT round(gx, 9) AS recall, round(CASE WHEN x1 IS NULL OR gx < x THEN y ELSE y + (y1 - y) * (gx - x) / (x1 - x) END, 9) AS precision FROM g LEFT JOIN w ON (gx >= x AND (gx < x1 OR x1 IS NULL)) OR (f AND gx < x)"""
_SAFE = SCORED.replace("toxic AS y", "1 - toxic AS y").replace(", 3) AS p FROM", ", 3) AS p0 FROM")
_AREA = lambda src: f"SELECT sum((recall - r0) * (precision + p0) / 2) AS a FROM (SELECT *, coalesce(lag(recall) OVER o, 0) AS r0, coalesce(lag(precision) OVER o, 1) AS p0 FROM (SELECT p, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / np AS recall FROM (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ({src}) GROUP BY p))) WINDOW o AS (ORDER BY p DESC))"

QUERIES: dict[str, Query] = {
    "enterprise_labels": _labels("enterprise", "sensitivity", "label", "'med'"),
    "business_labels": _labels("business", "label", "sensitivity", "NULL"),
    "masked_template_labels": Query(_masked, f"SELECT label, count(*) AS n, sum(least(length(trim(text)), 1000))::BIGINT AS chars FROM ({_TOP.replace('SELECT text,', 'SELECT doc_id, text,')}) WHERE length(trim(text)) >= 10 AND doc_id % 4 <> 0 GROUP BY label"),
    "token_tag_labels": Query(_tags, f"SELECT label, count(*) AS n FROM ({_TOP}) GROUP BY label"),
    "secret_labels": Query(_secret, _SECRET),
    "balanced_labels": Query(_balanced, "SELECT risk, count(*) AS n FROM (SELECT * FROM (SELECT trim(text) AS text, CASE doc_id % 4 WHEN 0 THEN 'med' WHEN 1 THEN 'high' WHEN 2 THEN 'low' END AS risk FROM documents) WHERE length(text) BETWEEN 12 AND 32000 AND risk IS NOT NULL ORDER BY md5(text), text, risk LIMIT 500) GROUP BY risk"),
    "union_first_wins": Query(_union, _UNION),
    "equal_thirds": Query(_thirds, _ranked(f"SELECT doc_id, {_THREE} AS label FROM documents", _T, f"CASE WHEN k >= {_T} THEN 1 ELSE ({_T} - r) // k + 1 END")),
    "binary_halves": Query(_halves, _ranked("SELECT doc_id, (doc_id % 3 = 0)::INT AS label FROM documents", "least(100, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id % 3 = 0)))", "CASE WHEN k >= least(100, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id % 3 = 0))) THEN 1 ELSE (least(100, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id % 3 = 0))) - r) // k + 1 END")),
    "candidate_hits": Query(_hits, _HITS_SQL),
    "miss_patterns": Query(_misses, _MISSES),
    "error_rows": Query(_errors, f"SELECT doc_id, truth, z, p, truth = 'high' AS missed_high FROM ({_CLASSES}) WHERE truth <> z"),
    "threshold_check": Query(_check, _sql_rounded(f"WITH s AS ({SCORED}), g AS (SELECT unnest([0.35, 0.40, 0.45, 0.50])::DOUBLE AS threshold), c AS ({_AT}), {_SIDES} SELECT threshold, row_number() OVER (ORDER BY macro_f1 DESC, safe_recall DESC, precision DESC, fpr, threshold)::INTEGER AS place, {', '.join(_SIDED)} FROM f", *_SIDED)),
    "two_sided_metrics": Query(_sides, _sql_rounded(f"WITH s AS ({SCORED}), g AS (SELECT 0.45::DOUBLE AS threshold), c AS (SELECT * EXCLUDE (threshold) FROM ({_AT})), {_SIDES} SELECT tp, tn, fp, fn, {', '.join(_SIDED)} FROM f", *_SIDED)),
    "class_limits": Query(lambda t, spark: evaluate.class_limits(evaluate.pr_curve(scored_labels(t), "y", "p")), _CURVE + ", l AS (SELECT round(min(p), 3) AS block FROM v WHERE precision >= 0.85 HAVING count(*) > 0) SELECT round(greatest(0.30, block - 0.15), 3) AS warn, block FROM l"),
    "macro_auprc": Query(lambda t, spark: _rounded(evaluate.macro_auprc(scored_labels(t).selectExpr("y", "round(p, 3) AS p"), "y", "p"), "macro_auprc"), f"SELECT round((({_AREA(SCORED)}) + ({_AREA(f'SELECT y, 1 - p0 AS p FROM ({_SAFE})')})) / 2, 9) AS macro_auprc"),
    "best_and_last_row": Query(_log, f"WITH l AS ({_LOG}), e AS (SELECT * FROM l WHERE eval_loss IS NOT NULL) SELECT 'best' AS which, (SELECT step FROM e WHERE metric IS NOT NULL ORDER BY metric DESC, step LIMIT 1) AS step UNION ALL SELECT 'last', (SELECT max(step) FROM e)"),
    "manual_overlap": Query(_manual, f"WITH d AS (SELECT md5({_KEY}) AS h, {SPLIT} AS s FROM documents WHERE text IS NOT NULL), m AS (SELECT DISTINCT h FROM d WHERE s = 'test') SELECT (SELECT count(*) FROM m WHERE h IN (SELECT h FROM d WHERE s = 'train')) AS in_train, (SELECT count(*) FROM m WHERE h IN (SELECT h FROM d WHERE s = 'validation')) AS in_validation"),
    "labelled_rows": Query(lambda t, spark: curate.labelled_rows(t("documents").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN ' ' END AS risk")).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND trim(coalesce(lang, '')) <> ''"),
    "small_corpus_guard": Query(_guard, _GUARD),
}

#: SQL for queries of other modules.
MORE_SQL = {"gate_metrics": _gate_sql(), "three_class_sweep": _SWEEP3, "curve_resample": _RESAMPLE}
