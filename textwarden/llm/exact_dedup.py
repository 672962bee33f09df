"""Exact deduplication by a heavy-hitter split, with DataFrame functions only.

Each text, without its white space, becomes a SHA-256 digest; digests, lengths and row numbers (no texts) are
written once. A Misra-Gries summary of the digests (Spark's ``freqItems``, the frequent-element count by Karp,
Schenker and Papadimitriou: a bounded map of counters that all go down when it is full, merged over tasks) names
every digest that more than one row in ``counters`` has. A pass over these candidates verifies them: it counts
their rows and finds the row of each that stays, with partial aggregates, so a digest that a third of all rows share is one
row per task. The winners, ``counters`` rows at most, are broadcast, and their copies are decided map-side. All other digests
meet by an ordinary shuffle, in groups below one row in ``counters``.

The row with the most code points before white space was deleted stays, then the smallest id.

Results for odd input: null text counts as empty, and all texts without other characters are equal; a null id
comes after all others; of rows that tie in length and id (repeated rows) exactly one stays, whichever was
written first, and ``keep_id`` names the id of all; a very long text is digested whole; extra columns are ignored, whatever their
names, but for those named in ``carry``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
#: Counters of the Misra-Gries summary: a digest with more than 1 / COUNTERS of the rows is found.
COUNTERS = 1024


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_sha256, n_chars of the whole text, row_no, and the struct ``row`` of the carried columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    return docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.regexp_replace(text, SPACE, "").cast("binary"), 256).alias("text_sha256"), F.length(text).alias("n_chars"),
        F.monotonically_increasing_id().alias("row_no"), *row,
    )


def frequent(told: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """text_sha256 of candidates: at most ``counters``, with every digest that more than one row in ``counters`` has."""
    return told.stat.freqItems(["text_sha256"], 1.0 / counters).select(F.explode("text_sha256_freqItems").alias("text_sha256"))


def winners(told: DataFrame, candidates: DataFrame) -> DataFrame:
    """text_sha256, group_size, first (the row that stays) of the candidates, counted exactly."""
    best = F.min(F.expr("struct(-n_chars AS less, doc_id IS NULL AS last, doc_id, row_no)")).alias("first")
    return told.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best)


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", counters: int = COUNTERS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and ``row`` if columns are carried."""
    told = stored(digests(docs, text_col, id_col, carry), "digests")
    heavy = F.broadcast(stored(winners(told, frequent(told, counters)), "winners"))
    more = ["row"] if carry else []
    settled = told.join(heavy, "text_sha256").selectExpr("doc_id", "first.doc_id AS keep_id", "group_size", "row_no = first.row_no AS kept", "text_sha256", *more)
    order = "PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST, row_no"
    rest = (
        told.join(heavy, "text_sha256", "left_anti")
        .selectExpr("*", "count(1) OVER (PARTITION BY text_sha256) AS group_size", f"first_value(struct(doc_id, row_no)) OVER ({order}) AS first")
        .selectExpr("doc_id", "first.doc_id AS keep_id", "group_size", "row_no = first.row_no AS kept", "text_sha256", *more)
    )
    return settled.unionByName(rest)


def distinct(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return groups(docs, text_col, id_col, counters, tuple(docs.columns)).where("kept").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, coalesce(length(text), 0) AS n FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
"""
