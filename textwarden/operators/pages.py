"""Documents as pages: spans found in chunks and put back into pages and documents, and the roll-up from pages.

A page is cut into chunks that share ``overlap`` characters. Spans are found chunk by chunk, shifted by the chunk's place, and
joined: pieces of one class that overlap are one span. A piece that touches a cut is kept only as part of such a union, with a whole span or with
the piece on the other side of the cut, as a detector may take a cut for the end of a word. So a match up to the overlap in length is found as in the whole page,
wherever the cuts lie, and a longer one by its pieces. Pages lie one after the other in a document: their offsets are sums of the lengths before.

Null texts are empty pages. A chunk is a row, so the longest page is many small rows; a span is a row until pages are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.patterns import MEDIUM, STRONG, Pattern
from textwarden.operators import scan, spans
from textwarden.operators.policy import Policy

#: Classes whose presence on a page blocks it.
CRITICAL = ("SSN pattern", "credit card pattern", "API key pattern", "JWT pattern", "IBAN pattern", "IBAN")


def cut(df: DataFrame, key: str, text_col: str = "text", size: int = 3000) -> DataFrame:
    """(key, page, text): documents without pages of their own, cut at every ``size`` characters; an empty text is one page."""
    last = F.greatest(F.floor((F.length(F.coalesce(text_col, F.lit(""))) - 1) / size), F.lit(0)).cast("int")
    each = df.select(key, F.coalesce(text_col, F.lit("")).alias("_text"), F.posexplode(F.sequence(F.lit(0), last)).alias("_i", "page"))
    return each.select(key, "page", F.expr(f"substring(_text, page * {size} + 1, {size})").alias("text"))


def placed(pages: DataFrame, key: str, page: str = "page", text_col: str = "text", gap: int = 0) -> DataFrame:
    """pages with ``page_offset``: the characters of the pages before, and ``gap`` for each of them."""
    before = f"coalesce(sum(length(coalesce(`{text_col}`, '')) + {gap}) OVER (PARTITION BY `{key}` ORDER BY `{page}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return pages.withColumn("page_offset", F.expr(f"cast({before} AS bigint)"))


def chunk_spans(pages: DataFrame, keys: list[str], patterns: tuple[Pattern, ...] = (*STRONG, *MEDIUM), text_col: str = "text", size: int = scan.SIZE, overlap: int = scan.OVERLAP) -> DataFrame:
    """(keys, class, source, risk, start, end): the spans of pages, from their chunks."""
    ks = [f"`{k}`" for k in keys]
    last = f"CASE WHEN length(_text) <= {size} THEN 0 ELSE length(_text) - 1 END"
    d = pages.where(F.length(text_col) > 0).selectExpr(*ks, f"`{text_col}` AS _text").selectExpr(*ks, "_text", f"explode(sequence(0, {last}, {size - overlap})) AS _from")
    d = d.selectExpr(*ks, "_from", f"substring(_text, _from + 1, {size}) AS _chunk", f"_from + {size} < length(_text) AS _more")
    found = spans.find_all(d, patterns, "_chunk", "_found").selectExpr(*ks, "_from", "_more", "length(_chunk) AS _size", "inline(_found)")
    piece = found.selectExpr(
        *ks, "class", "source", "risk", "start + _from AS start", "`end` + _from AS `end`", "start = 0 AND _from > 0 AS _left", "`end` = _size AND _more AS _right",
    )
    return union(piece, keys)


def union(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Spans from pieces (keys, class, source, risk, start, end, and whether they touch a cut on the left or right)."""
    by = ", ".join(f"`{k}`" for k in [*keys, "class", "source", "risk"])
    order = f"PARTITION BY {by} ORDER BY start, `end`"
    new = f"CASE WHEN start < max(`end`) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS _new"
    d = pieces.selectExpr("*", new).selectExpr("*", f"sum(_new) OVER ({order} ROWS UNBOUNDED PRECEDING) AS _island")
    g = d.groupBy(*keys, "class", "source", "risk", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.expr("bool_or(NOT _left AND NOT _right) OR bool_or(_left) AND bool_or(_right)").alias("_real"))
    return g.where("_real").drop("_island", "_real")


def page_scan(pages: DataFrame, key: str, page: str = "page", text_col: str = "text", policy: Policy | None = None, patterns: tuple[Pattern, ...] = (*STRONG, *MEDIUM)) -> DataFrame:
    """A row per page (of unique key and page): page_offset, risk, risk_score, action, chunks, triggers, and ``spans`` with offsets in the page.

    Scores come from the chunks; a critical class among the page's spans blocks it with score 100.
    """
    p = placed(pages, key, page, text_col).selectExpr(f"`{key}` AS _doc", f"`{page}` AS _page", f"`{text_col}` AS _text", "page_offset", f"to_json(struct(`{key}`, `{page}`)) AS _key")
    scored = scan.scan(p, "_key", "_text", policy)
    found = chunk_spans(p, ["_key"], patterns, "_text").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "class", "source", "risk"))).alias("spans"))
    out = p.drop("_text").join(scored, "_key").join(found, "_key", "left")
    critical = F.exists("spans", lambda s: s["class"].isin(*CRITICAL)) | (F.col("overall_risk") == "high")
    critical = F.coalesce(critical, F.col("overall_risk") == "high")
    return out.select(
        F.col("_doc").alias(key), F.col("_page").alias(page), "page_offset",
        F.when(critical, "high").otherwise(F.col("overall_risk")).alias("risk"), F.when(F.coalesce(F.exists("spans", lambda s: s["class"].isin(*CRITICAL)), F.lit(False)), 100).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(critical, "block").when(F.col("overall_risk") == "med", "warn").otherwise("silent").alias("action"), "chunks_scored", "flagged_chunks", "triggers",
        F.coalesce("spans", F.expr("cast(array() AS array<struct<start:int,end:int,class:string,source:string,risk:string>>)")).alias("spans"),
    )


def rollup(scanned: DataFrame, key: str, page: str = "page") -> DataFrame:
    """A row per document: overall_risk, risk_score, page_count, flagged_pages, issue_count, pii_classes, and ``findings``: the spans with offsets in the document."""
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("page_offset")).alias("start"), (s["end"] + F.col("page_offset")).alias("end"), s["class"].alias("class"), F.col(page).alias("page")))
    d = scanned.select(key, page, "action", "risk_score", shifted.alias("_found"))
    flagged = F.when(F.col("action") != "silent", F.col(page))
    rank = F.max(F.expr("CASE action WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END"))
    out = d.groupBy(key).agg(
        rank.alias("_act"), F.max("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("page_count"), F.array_sort(F.collect_set(flagged)).alias("flagged_pages"),
        F.array_sort(F.flatten(F.collect_list("_found"))).alias("findings"),
    )
    return out.select(
        key, F.when(F.col("_act") == 2, "high").when(F.col("_act") == 1, "med").otherwise("low").alias("overall_risk"), "risk_score", "page_count", "flagged_pages",
        F.size("findings").cast("long").alias("issue_count"), F.array_sort(F.array_distinct(F.transform("findings", lambda s: s["class"]))).alias("pii_classes"), "findings",
    )
