"""Periodic runs of words by the harmonic grid.

A run is a stretch of words with smallest period q and at least ``times`` periods (and LEAST words) that no neighbouring word extends.
For each period p the words at the multiples of p are a grid; a run with ``times`` or more periods holds ``times``
neighbouring grid points at least. Forward and backward longest common extensions between jp and (j+1)p give
the whole stretch with period p around them. Extensions come from suffix arrays of the text and of the reversed text, their common
prefixes and range minima over these (:class:`Extensions`). Where the two words differ the forward extension is 0, so
only chains of equal neighbouring grid points, as many as a run needs, are asked for, and only texts with such a chain get suffix arrays.
Small periods are walked one by one over all texts of a piece, large ones grid point by grid point over all (text, period) at once.
A run is found for its period and for its multiples; the smallest is kept.

Texts are judged alone, in tasks of their own: nothing is shuffled. A piece is some 2 MB of texts or one longer text; a text with
n words takes a few hundred bytes for each of them while it is searched. Words are compared by 64-bit hashes.

Results for odd input: null, empty or blank text has no words, no run (nulls for the longest) and the digests of empty strings; ties for the
longest run go to the smallest start, then the smallest period; repeated rows and null ids are judged alike; a very long text is judged whole; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm import blocks as B
from textwarden.llm.hashing import covered, expand, true_runs
from textwarden.llm.storage import give_back
from textwarden.llm.suffixes import Extensions

WORD = r"[^\x20\x09-\x0D]+"
#: Periods and words that a run has at least; bytes of text searched at once.
TIMES, LEAST = 4, 6
PIECE = 2 << 20


def grid_chains(s: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of jp, p) of the grid points jp with s[jp] = s[(j+1)p], in chains as long as a run needs."""
    size = np.diff(first)
    by = np.argsort(-size, kind="stable")
    by = by[size[by] >= max(least, times)]
    none = np.zeros(0, np.int64)
    out = [(none, none, none)]
    if not len(by):
        return out[0]
    n, begin = size[by], first[by]
    small = max(isqrt(int(n[0])), 1)
    for p in range(1, min(small, int(n[0]) // times) + 1):
        need = max(times, least // p) - 1
        k = int(np.searchsorted(-n, -max(least, times * p), "right"))
        points = (n[:k] - 1) // p + 1  # the last one has no partner
        j = expand(np.zeros(k, np.int64), points)
        x = np.repeat(begin[:k], points) + p * j
        equal = s[x] == s[np.minimum(x + p, len(s) - 1)]
        equal[np.cumsum(points) - 1] = False
        lo, hi = true_runs(equal)
        long = hi - lo >= need
        if long.any():
            at = expand(lo[long], (hi - lo)[long])
            out.append((np.repeat(by[:k], points)[at], x[at], np.full(len(at), p)))
    many = np.maximum(n // times - small, 0)
    text, p = np.repeat(np.arange(len(n)), many), expand(np.full(len(n), small + 1), many)
    if not len(p):
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
    pairs = (n[text] - 1) // p
    order = np.argsort(-pairs, kind="stable")
    text, p, pairs = text[order], p[order], pairs[order]
    x, chain, need = begin[text], np.zeros(len(p), np.int32), times - 1
    left = np.searchsorted(-pairs, -np.arange(1, int(pairs[0]) + 1), "right")
    for k in left.tolist():
        equal = s[x[:k]] == s[x[:k] + p[:k]]
        chain[:k] = (chain[:k] + 1) * equal
        at = np.flatnonzero(chain[:k] >= need)
        if len(at):
            back = np.where(chain[at] == need, need, 1)  # a chain's first points are told when it is long enough
            who = np.repeat(at, back)
            out.append((by[text[who]], x[who] - p[who] * expand(np.zeros(len(at), np.int64), back), p[who]))
        x[:k] += p[:k]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def runs(s: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, length, smallest period) of all runs, by text, start and period. Text i is s[first[i]:first[i + 1]]."""
    text, x, p = grid_chains(s, first, times, least)
    if not len(text):
        return text, x, p, p
    live, own = np.unique(text, return_inverse=True)
    size = first[live + 1] - first[live]
    _, symbol = np.unique(s[expand(first[live], size)], return_inverse=True)
    base = np.cumsum(size + 1) - size  # a separator of its own before each text, and one at the end
    n = int(size.sum()) + len(live) + 1
    joined = np.arange(n) + len(symbol)
    joined[expand(base, size)] = symbol
    x = base[own] + x - first[text]
    forth = Extensions(joined).of(x, x + p)
    back = Extensions(joined[::-1]).of(n - x, n - x - p)
    start, length = x - back - base[own], forth + back + p
    good = length >= np.maximum(least, times * p)
    text, start, length, p = text[good], start[good], length[good], p[good]
    order = np.lexsort((p, length, start, text))
    text, start, length, p = text[order], start[order], length[order], p[order]
    new = np.ones(len(text), bool)  # of the periods of one stretch, the smallest
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, p = text[new], start[new], length[new], p[new]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


def repeated_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    return covered(n, start + period, start + length)


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text_collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(docs: pa.Table) -> pa.Table:
    b = B.Block(docs)
    s, first = B.word_hashes(b)
    text, start, length, period = runs(s, first)
    cut = np.searchsorted(text, np.arange(b.n + 1))
    found, collapsed = [], []
    for i in range(b.n):
        words = b.text(i).split()
        at = slice(cut[i], cut[i + 1])
        if cut[i + 1] > cut[i]:
            gone = repeated_words(len(words), start[at], length[at], period[at]).tolist()
            words = [w for w, g in zip(words, gone, strict=True) if not g]
        found.append([{"start": x, "length": y, "period": z} for x, y, z in zip(start[at].tolist(), length[at].tolist(), period[at].tolist(), strict=True)])
        collapsed.append(b" ".join(words))
    return pa.table({"doc_id": b.doc_id, "n_words": pa.array(np.diff(first), pa.int64()), "runs": pa.array(found, _RUNS), "text_collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, runs (by start, then period), and text_collapsed: its words without those that repeat a run's first period."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            size = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy()
            piece = (np.cumsum(size) - size) // PIECE
            cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)) if len(size) else np.zeros(0, np.int64)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from _searched(table.slice(a, z - a)).to_batches()
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    line = "concat(r.start, ',', r.length, ',', r.period, '\\n')"
    longest = "array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))"
    out = found.selectExpr("doc_id", "n_words", "cast(size(runs) AS bigint) AS n_runs", f"{longest} AS top", f"array_join(transform(runs, r -> {line}), '') AS told", "text_collapsed")
    return out.selectExpr(
        "doc_id", "n_words", "n_runs", "top.start AS start", "-top.less AS length", "top.period AS period", "1000 * -top.less div top.period AS exponent_milli",
        "sha2(cast(told AS binary), 256) AS runs_sha256", "sha2(cast(text_collapsed AS binary), 256) AS collapsed_sha256",
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(id) is divisible by 10 the words from a = floor(h / 10) mod n on repeat p words, p = 1 + floor((n - a) / (3 + floor(h / 10) mod 8))."""
    d = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text", "crc32(cast(doc_id AS string)) AS h")
    d = d.selectExpr("doc_id", "text", "h div 10 AS g", rf"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, r'{WORD}', 0) END AS words")
    d = d.selectExpr("doc_id", "text", "g", "words", "size(words) AS n", "CASE WHEN size(words) > 0 THEN cast(g % size(words) AS int) END AS a")
    d = d.selectExpr("doc_id", "text", "words", "n", "a", "cast(1 + (n - a) div (3 + g % 8) AS int) AS p")
    turned = "concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 AS int))), 1, n - a))"
    return d.selectExpr("doc_id", f"CASE WHEN a IS NULL THEN text ELSE array_join({turned}, ' ') END AS text")
