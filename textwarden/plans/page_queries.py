"""Queries on pages: spans from chunks against those of whole pages, and the roll-up to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions.dialect import CHECK
from textwarden.functions.patterns import STRONG
from textwarden.operators import pages, spans
from textwarden.plans.common import Query, dealt

_SIZE = 1700
_SEEN = tuple(p for p in STRONG if p.name in ("email address", "IP address (IPv4)", "bank routing number"))


def _pages(t):
    return pages.cut(dealt(t("documents").select("doc_id", "text")), "doc_id", size=_SIZE)


_PAGES = f"""p AS (SELECT doc_id, page, substring(text, page * {_SIZE} + 1, {_SIZE}) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, greatest((length(coalesce(text, '')) - 1) // {_SIZE}, 0) + 1)) AS page FROM documents)),
    o AS (SELECT *, {CHECK.ascii_bounds('text')} AS plain, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_offset FROM p)"""
_FOUND = " UNION ALL ".join(f"SELECT doc_id, page, page_offset, {CHECK.q(p.name)} AS class, unnest({spans.offsets(CHECK, 'plain', p.regex)}) AS s FROM o WHERE {CHECK.rx('plain', p.regex)}" for p in _SEEN)


def _page_spans(t, spark):
    placed = pages.placed(_pages(t), "doc_id")
    found = pages.chunk_spans(placed, ["doc_id", "page", "page_offset"], _SEEN)
    return found.selectExpr("doc_id", "page", "class", "start + page_offset AS start_at", "`end` + page_offset AS end_at")


_PAGE_SPANS = f"""WITH {_PAGES} SELECT doc_id, page::INT AS page, class, (s.start + page_offset)::BIGINT AS start_at, (s."end" + page_offset)::BIGINT AS end_at FROM ({_FOUND})"""


def _rollup(t, spark):
    r = pages.rollup(pages.page_scan(_pages(t), "doc_id", patterns=_SEEN), "doc_id")
    sums = [F.expr(f"cast(aggregate(findings, 0L, (x, s) -> x + s.{c}) AS bigint)").alias(f"{c}_sum") for c in ("start", "end")]
    return r.select("doc_id", "page_count", "issue_count", F.array_join("pii_classes", "|").alias("classes"), *sums)


_ROLLUP = f"""WITH {_PAGES}, f AS (SELECT doc_id, class, s.start + page_offset AS a, s."end" + page_offset AS z FROM ({_FOUND})),
    n AS (SELECT doc_id, count(*) AS page_count FROM p GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS issue_count, array_to_string(list_sort(list(DISTINCT class)), '|') AS classes, sum(a) AS a, sum(z) AS z FROM f GROUP BY doc_id)
    SELECT doc_id, page_count, coalesce(issue_count, 0)::BIGINT AS issue_count, coalesce(classes, '') AS classes, coalesce(a, 0)::BIGINT AS start_sum, coalesce(z, 0)::BIGINT AS end_sum FROM n LEFT JOIN c USING (doc_id)"""

QUERIES = {"page_spans": Query(_page_spans, _PAGE_SPANS), "document_rollup": Query(_rollup, _ROLLUP)}
