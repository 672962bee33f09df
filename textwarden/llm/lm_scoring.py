"""Stupid-backoff language-model scores from corpus-wide n-gram counts.

The count tables of all orders are one table of 64-bit n-gram hashes dealt by hash range; the
documents' exploded n-grams join it in their blocks' sorted order, and log scores are
summed per document (:func:`blocks.corpus_counts` has the exchange). Counts cover the whole corpus.

S(w | h) = count(h w) / count(h) if count(h w) >= ``least``, else ``backoff`` * S(w | shorter h);
S(w) = count(w) / words of the corpus. N-grams are told apart by ``HASH_BITS`` bits of their hash: with
10^9 different ones a count is wrong with probability 6e-8. With ``least`` = 2, an n-gram that only the
document itself has once counts as unseen.

Results for odd input: null or blank text has no words and the score 0.0; a document's first
words use the history there is; words are case-folded for A-Z only; repeated rows all count
and all get scores; a count of exactly ``least`` is seen; a very long text is a block of its own and scored whole; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm import blocks as B
from textwarden.llm.hashing import Rolling

HASH_BITS = 54
WORD = r"[^\x20\x09-\x0D]+"


def _grams(table: pa.Table, order: int) -> tuple[B.Block, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The block, its word offsets, and per order the hashes of all n-grams and which lie in one document."""
    b = B.Block(table)
    words, first = B.word_hashes(b, fold=True)
    roll = Rolling(words)
    high = np.uint64((1 << 64) - (1 << 64 - HASH_BITS))  # zero low bits cost nothing when packed
    hashes = [roll.windows(k) & high for k in range(1, order + 1)]
    return b, first, hashes, [B.inside(first, len(words), k) for k in range(1, order + 1)]


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score."""
    total = docs.agg(F.sum(F.regexp_count(F.col(text_col), F.lit(WORD)))).first()[0] or 0
    lay = B.layout(docs, text_col)
    blocks = B.blocked(docs, lay, id_col, text_col)

    def grams(table: pa.Table) -> np.ndarray:
        _, _, hashes, ok = _grams(table, order)
        return np.concatenate([h[m] for h, m in zip(hashes, ok, strict=True)])

    def work(docs: pa.Table, back: pa.Table) -> pa.Table:
        b, first, hashes, ok = _grams(docs, order)
        n = int(first[-1])
        values, place = np.unique(np.concatenate([h[m] for h, m in zip(hashes, ok, strict=True)]), return_inverse=True)
        count = B.block_counts(values, back).astype(np.float64)[place] if len(values) else np.zeros(0)
        cut = np.cumsum([m.sum() for m in ok])[:-1]
        by_start = []
        for c, m in zip(np.split(count, cut), ok, strict=True):
            full = np.zeros(n)
            full[: len(m)][m] = c
            by_start.append(full)
        # from the shortest history to the longest that was seen; the word's place is the n-gram's end
        s = by_start[0] / max(total, 1)
        for k in range(2, order + 1):
            m = np.zeros(n, bool)
            m[k - 1 :] = ok[k - 1]
            seen = np.zeros(n)
            seen[k - 1 :] = by_start[k - 1][: n - k + 1]
            history = np.ones(n)
            history[k - 1 :] = by_start[k - 2][: n - k + 1]
            s = np.where(m, np.where(seen >= least, seen / np.maximum(history, 1), backoff * s), s)
        doc = np.repeat(np.arange(b.n), np.diff(first))
        logs = np.bincount(doc, np.log(s), minlength=b.n) if n else np.zeros(b.n)
        size = np.diff(first)
        return pa.table({"doc_id": b.doc_id, "n_words": pa.array(size, pa.int64()), "log_score": pa.array(logs), "mean_log_score": pa.array(logs / np.maximum(size, 1))})

    counts = B.corpus_counts(blocks, lay, grams)
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(work, "doc_id long, n_words long, log_score double, mean_log_score double")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT rid, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
u AS (SELECT w, count(*)::DOUBLE AS c FROM g GROUP BY w),
b AS (SELECT w1, w, count(*)::DOUBLE AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
t AS (SELECT w2, w1, w, count(*)::DOUBLE AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS total FROM p),
s AS (SELECT g.rid, CASE WHEN t.c >= 2 THEN t.c / h.c WHEN b.c >= 2 THEN (CASE WHEN g.w2 IS NULL THEN 1 ELSE 0.4::DOUBLE END) * b.c / v.c
      ELSE (CASE WHEN g.w1 IS NULL THEN 1 WHEN g.w2 IS NULL THEN 0.4::DOUBLE ELSE 0.16::DOUBLE END) * u.c / n.total END AS s
      FROM g CROSS JOIN n JOIN u ON u.w = g.w LEFT JOIN u v ON v.w = g.w1 LEFT JOIN b ON b.w1 = g.w1 AND b.w = g.w
      LEFT JOIN b h ON h.w1 = g.w2 AND h.w = g.w1 LEFT JOIN t ON t.w2 = g.w2 AND t.w1 = g.w1 AND t.w = g.w),
e AS (SELECT rid, sum(ln(s)) AS l FROM s GROUP BY rid)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, round(coalesce(l, 0), 4) AS log_score FROM d LEFT JOIN e USING (rid)
"""
