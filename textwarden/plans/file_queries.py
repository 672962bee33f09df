"""Queries on readers and writers of files: rows of the tables are written to the shared folder in a corpus's own form and read as the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textwarden.functions import text as X
from textwarden.functions.dialect import CHECK
from textwarden.operators import curate, feedback
from textwarden.plans.common import Query
from textwarden.sources import readers, writers
from textwarden.streaming import dedupe

_TRIM = "regexp_replace(text, '^ +| +$', '', 'g')"


def _folder(spark, name: str) -> str:
    return f"{writers.shared(spark)}/{uuid.uuid4().hex}-{name}"


def _mail(t, spark):
    path = _folder(spark, "mail.jsonl")
    t("documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN text END AS body", "CASE WHEN doc_id % 3 <> 0 THEN text END AS content").write.json(path)
    return readers.mail_corpus(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _tabular(t, spark):
    path = _folder(spark, "tabular.csv")
    t("documents").where("length(text) > 0").selectExpr("doc_id", "replace(text, '\\r', ' ') AS description", "CASE doc_id % 4 WHEN 0 THEN 'Restricted' WHEN 1 THEN 'internal' WHEN 2 THEN 'odd' END AS classification").write.option("header", True).option("escape", '"').csv(path)
    return readers.labelled(readers.raw(spark, path), "tabular").groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def _fragments(t, spark):
    d = t("documents").selectExpr("doc_id", "CASE doc_id % 5 WHEN 0 THEN 'API_Key' WHEN 1 THEN 'comment' WHEN 2 THEN 'call' WHEN 3 THEN '' END AS type", "slice(array('a', 'b', 'c', 'd'), 1, cast(doc_id % 4 AS int)) AS fragments")
    return readers.by_fragments(d, cap=None).select("doc_id", "risk")


_FRAGMENTS = """SELECT doc_id, CASE WHEN doc_id % 4 >= 3 OR doc_id % 5 = 0 THEN 'high' WHEN doc_id % 4 = 0 AND (doc_id % 5 IN (1, 3, 4)) THEN 'low' ELSE 'med' END AS risk FROM documents"""


def _span_lists(t, spark):
    """Each document with a list of doc_id % 5 spans, as JSON where its number is even, else as Python writes it."""
    pick = "element_at(array('name', 'SSN', 'it\\'s a \"city\"', 'critical_secret', 'phone'), cast((doc_id + i) % 5 + 1 AS int))"
    json = f"to_json(transform(filter(sequence(1, 4), i -> i <= doc_id % 5), i -> struct({pick} AS label, i AS start)))"
    quoted = f"CASE WHEN contains({pick}, '\\'') THEN concat('\\'', replace({pick}, '\\'', '\\\\\\''), '\\'') ELSE concat('\\'', {pick}, '\\'') END"
    python = f"concat('[', array_join(transform(filter(sequence(1, 4), i -> i <= doc_id % 5), i -> concat('{{\\'label\\': ', {quoted}, ', \\'start\\': ', i, ', \\'end\\': None}}')), ', '), ']')"
    d = t("documents").selectExpr("doc_id", f"CASE WHEN doc_id % 2 = 0 THEN {json} ELSE {python} END AS spans")
    return readers.by_spans(d).select("doc_id", "risk")


_SPAN_LISTS = """WITH d AS (SELECT doc_id, [(doc_id + i) % 5 for i in range(1, 5) if i <= doc_id % 5] AS k FROM documents),
    e AS (SELECT doc_id, list_contains(k, 3) AS settled, list_contains(k, 1) AS sharp, len(list_filter(k, lambda x: x <> 3)) AS n FROM d)
    SELECT doc_id, CASE WHEN settled OR sharp OR n >= 4 THEN 'high' WHEN n >= 2 THEN 'med' ELSE 'low' END AS risk FROM e"""


def _notes(t, spark):
    d = t("documents").where("length(text) > 0").selectExpr("concat('<note><TEXT>', CASE WHEN doc_id % 4 = 0 THEN '<PHI TYPE=\"NAME\">x</PHI> ' ELSE '' END, translate(text, '<>&', '   '), '</TEXT></note>') AS value")
    return readers.clinical_notes(d, most_chars=None).groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_NOTES = r"""WITH d AS (SELECT regexp_replace(regexp_replace((CASE WHEN doc_id % 4 = 0 THEN ' x ' ELSE ' ' END) || ' ' || translate(text, '<>&', '   '), '[\x09-\x0D\x20]+', ' ', 'g'), '^ | $', '', 'g') AS x, doc_id % 4 = 0 AS phi FROM documents WHERE length(text) > 0),
    g AS (SELECT x, bool_or(phi) AS phi FROM d GROUP BY x)
    SELECT CASE WHEN phi THEN 'high' ELSE 'med' END AS risk, count(*) AS n, sum(length(x))::BIGINT AS chars FROM g GROUP BY 1"""


def _manual(t, spark):
    d = t("documents").selectExpr("doc_id", "text AS prompt", "CASE doc_id % 5 WHEN 0 THEN ' HIGH' WHEN 1 THEN 'low' WHEN 2 THEN '' WHEN 3 THEN 'critical' END AS label")
    return readers.manual_rows(d).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def _gates(t, spark):
    d = t("documents").selectExpr("text", "CASE doc_id % 4 WHEN 0 THEN 'Safe' WHEN 1 THEN 'medium ' WHEN 2 THEN 'critical' ELSE 'odd' END AS label", "CASE doc_id % 7 WHEN 0 THEN 'BLOCK' WHEN 1 THEN '' END AS expected_action")
    return readers.gate_rows(d).groupBy("label", "expected_action").agg(F.count(F.lit(1)).alias("n"))


_GATES = """SELECT label, expected_action, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'safe' WHEN 1 THEN 'medium' WHEN 2 THEN 'critical' ELSE 'odd' END AS label,
    CASE WHEN doc_id % 7 = 0 THEN 'block' ELSE CASE doc_id % 4 WHEN 0 THEN 'silent' WHEN 1 THEN 'warn' WHEN 2 THEN 'block' ELSE 'warn' END END AS expected_action FROM documents WHERE trim(text) <> '') GROUP BY 1, 2"""


def _logged(t, spark):
    """Scoring events appended in two goes to the log, read again; texts are there as hashes only."""
    path = _folder(spark, "events")
    d = t("documents").selectExpr("text", "source AS pii_class", "doc_id / 7 AS confidence", "CASE WHEN doc_id % 3 = 0 THEN 'block' ELSE 'silent' END AS action", "doc_id")
    for part in (0, 1):
        writers.append_events(d.where(f"doc_id % 2 = {part}"), path)
    back = spark.read.parquet(path)
    return back.select("text_hash", "action", F.get_json_object("context_json", "$.doc_id").cast("long").alias("doc_id"))


def _tail(t, spark):
    path = _folder(spark, "telemetry")
    t("events").selectExpr("event_id", "date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS') || '-' || lpad(event_id, 12, '0') AS timestamp").write.json(path)
    return readers.telemetry_tail(spark, path, 50).select("event_id")


def _lines(t, spark):
    path = _folder(spark, "lines")
    t("documents").selectExpr("to_json(struct(doc_id)) AS value").union(t("documents").selectExpr("'  ' AS value")).write.text(path)
    return readers.line_counts(spark, path).agg(F.sum("lines").alias("lines"))


def _gated(t, spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    snoozes = spark.range(2).select(F.when(F.col("id") == 0, at("2024-01-10 00:00:00")).otherwise(at("2024-02-01 12:00:00")).alias("start"), F.when(F.col("id") == 0, at("2024-01-20 00:00:00")).otherwise(at("2024-02-01 18:00:00")).alias("end"))
    return dedupe.gate(t("clicks"), "coalesce(value > 90, false)", "kind IS NOT NULL", snoozes).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_GATED = """SELECT kind, count(*) AS n FROM clicks WHERE NOT coalesce(value > 90, false) AND kind IS NOT NULL AND NOT coalesce(ts >= '2024-01-10'::TIMESTAMP AND ts < '2024-01-20'::TIMESTAMP, false)
    AND NOT coalesce(ts >= '2024-02-01 12:00:00'::TIMESTAMP AND ts < '2024-02-01 18:00:00'::TIMESTAMP, false) GROUP BY kind"""


def _reviewed(t, spark):
    rows = t("documents").selectExpr("doc_id AS line", "CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'pending' END AS review_status")
    return feedback.review(rows, "line", [3, 8, 13, 21]).groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))


def _span_splits(t, spark):
    d = t("documents").selectExpr("cast(doc_id AS string) AS key", "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS risk", "doc_id")
    s = curate.span_splits(d.where("doc_id % 10 < 8"), d.where("doc_id % 10 >= 8"), "key")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_SPAN_SPLITS = """WITH t AS (SELECT doc_id % 3 AS k FROM documents WHERE doc_id % 10 < 8 ORDER BY md5('42|' || doc_id), doc_id::VARCHAR LIMIT 20000), r AS (SELECT k, count(*) AS n FROM t GROUP BY k),
    c AS (SELECT CASE WHEN (SELECT min(n) FROM r) >= 2 THEN k ELSE 0 END AS k, sum(n) AS n FROM r GROUP BY 1)
    SELECT 'train' AS split, sum(round(n * 0.85::DOUBLE))::BIGINT AS n FROM c UNION ALL SELECT 'validation', least(3000, sum(n - round(n * 0.85::DOUBLE)))::BIGINT FROM c UNION ALL SELECT 'test', least(5000, count(*)) FROM documents WHERE doc_id % 10 >= 8"""

QUERIES = {
    "mail_corpus": Query(_mail, f"SELECT 'mail' AS source, count(*) AS n, sum(length({_TRIM}))::BIGINT AS chars FROM documents WHERE {_TRIM} <> ''"),
    "tabular_labels": Query(_tabular, f"SELECT CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'med' END AS risk, count(*) AS n FROM documents WHERE length({_TRIM}) > 0 GROUP BY 1"),
    "fragment_risks": Query(_fragments, _FRAGMENTS),
    "span_list_risks": Query(_span_lists, _SPAN_LISTS),
    "clinical_notes": Query(_notes, _NOTES),
    "manual_rows": Query(_manual, f"SELECT CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'med' END AS risk, count(*) AS n FROM documents WHERE {_TRIM} <> '' GROUP BY 1"),
    "gate_rows": Query(_gates, _GATES),
    "logged_events": Query(_logged, f"SELECT {X.text_hash(CHECK, 'text')} AS text_hash, CASE WHEN doc_id % 3 = 0 THEN 'block' ELSE 'silent' END AS action, doc_id FROM documents"),
    "telemetry_tail": Query(_tail, "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "line_counts": Query(_lines, "SELECT count(*) AS lines FROM documents"),
    "gated_clicks": Query(_gated, _GATED),
    "reviewed_rows": Query(_reviewed, "SELECT CASE WHEN doc_id IN (3, 8, 13, 21) THEN 'approved' WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'pending' END AS review_status, count(*) AS n FROM documents GROUP BY 1"),
    "span_corpus_splits": Query(_span_splits, _SPAN_SPLITS),
}
