"""Suffix-array deduplication of byte strings by two-stage suffix sorting.

Segments with repeated anchors meet in buckets (:mod:`textwarden.llm.repeats`). A bucket's
distinct segments become one text. Suffixes smaller than their successors are sorted
directly, by 8-byte keys and, where these tie, by their first ``width`` bytes; all
others are induced by one scan over the first-byte buckets. Then the common prefix of
neighbours in suffix order is computed: ``width`` bytes or more make both starts repeats.

Results for odd input: null text is empty and yields zero bytes; documents shorter than ``width``
keep everything; repeated rows count as other occurrences; ties in the order (equal
``width``-byte prefixes) stay neighbours, whichever comes first; a cut inside a multi-byte
character is allowed, so what is kept is bytes; a very long text is judged whole, in a block of its own. Extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm import blocks as B
from textwarden.llm import repeats as R
from textwarden.llm.hashing import expand, true_runs

#: Anchors are 32-byte grams, one in 24.
GRAM, EVERY = 32, 24
#: Bytes are symbols here, each with some 100 bytes of working arrays, so blocks and buckets are small.
BLOCK_BYTES, BUCKET_BYTES = 3 << 19, 6 << 20


def _keys(text: np.ndarray) -> np.ndarray:
    """The 8 symbols from each place on, as one big-endian number."""
    pad = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | pad[i : i + len(text)]
    return key


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one isn't."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    ends = np.flatnonzero(differs)
    run = np.searchsorted(ends, np.arange(n))
    last = ends[run]
    up = np.zeros(n, bool)
    inner = last < n - 1
    up[inner] = text[np.minimum(last[inner] + 1, n - 1)] > text[last[inner]]
    return up


def sort_direct(text: np.ndarray, key: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``at`` in order of their first ``depth`` symbols."""
    at = at[np.argsort(key[at], kind="stable")]
    if depth <= 8 or len(at) < 2:
        return at
    k = key[at]
    tie = np.zeros(len(at), bool)
    same = k[1:] == k[:-1]
    tie[1:] |= same
    tie[:-1] |= same
    if not tie.any():
        return at
    raw = text.tobytes() + bytes(depth)
    lo, hi = true_runs(tie)
    # a run of ties may hold several keys, but its order by prefix keeps them apart
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        part = at[a:b].tolist()
        part.sort(key=lambda i: raw[i : i + depth])
        at[a:b] = part
    return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by two-stage sorting, exact for the first ``depth`` symbols."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = smaller_than_next(text)
    direct = sort_direct(text, _keys(text), np.flatnonzero(small), depth)
    size = np.bincount(text, minlength=256)
    n_small = np.bincount(text[direct], minlength=256)
    begin = np.cumsum(size) - size
    order = np.full(n, -1, np.int64)
    of = text[direct]
    cut = np.searchsorted(of, np.arange(257))
    for c in np.flatnonzero(n_small):
        order[begin[c] + size[c] - n_small[c] : begin[c] + size[c]] = direct[cut[c] : cut[c + 1]]
    head = begin.copy()

    def place(found: np.ndarray) -> None:
        """Predecessors that are larger than the suffixes found go to the front of their buckets, in order."""
        prev = found[found > 0] - 1
        prev = prev[~small[prev]]
        if not len(prev):
            return
        c = text[prev]
        by = np.argsort(c, kind="stable")
        prev, c = prev[by], c[by]
        where = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        for x, y in zip(where, np.append(where[1:], len(prev)), strict=True):
            b = c[x]
            order[head[b] : head[b] + y - x] = prev[x:y]
            head[b] += y - x

    place(np.array([n]))  # the last suffix, before the empty one
    for c in np.flatnonzero(size):
        done = begin[c]
        while done < head[c]:  # the scan meets what it has just placed in this bucket
            upto = head[c]
            place(order[done:upto])
            done = upto
        place(order[begin[c] + size[c] - n_small[c] : begin[c] + size[c]])
    return order


def common_prefix(key: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at a and b share ``depth`` symbols, 8 at a time."""
    live = np.arange(len(a))
    for d in range(0, depth, 8):
        d = min(d, max(0, depth - 8))
        live = live[key[a[live] + d] == key[b[live] + d]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def match(body: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows that occur elsewhere in the concatenated segments."""
    n, hit = len(body), np.zeros(len(body), bool)
    if not n:
        return hit
    first = np.cumsum(lengths) - lengths
    place = np.arange(n) + np.repeat(np.arange(len(lengths)), lengths)  # one separator after each segment
    text = np.zeros(n + len(lengths), np.uint8)
    text[place] = body + np.uint8(1)  # 0xFF never occurs in UTF-8
    starts = np.zeros(len(text), bool)
    starts[place[expand(first, np.maximum(lengths - width + 1, 0))]] = True
    order = suffix_order(text, width)
    order = order[starts[order]]
    if len(order) < 2:
        return hit
    if width >= 8:
        same = common_prefix(_keys(text), order[:-1], order[1:], width)
    else:
        same = np.array([text[x : x + width].tobytes() == text[y : y + width].tobytes() for x, y in zip(order[:-1], order[1:], strict=True)], bool)
    twice = np.zeros(len(text), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    hit[:] = twice[place]
    return hit


def _stream(table: pa.Table) -> R.Stream:
    b = B.Block(table)
    return R.Stream(b.bytes, b.offsets)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: byte counts, removed spans, the bytes kept and their digest.

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else.
    """
    lay = B.layout(docs, text_col, BLOCK_BYTES, BUCKET_BYTES)
    blocks = B.blocked(docs, lay, id_col, text_col)
    plan = R.Plan(width=width, gram=min(GRAM, width), every=EVERY, symbols="uint8")

    def work(docs: pa.Table, back: pa.Table) -> pa.Table:
        b = B.Block(docs)
        gone = R.coverage(len(b.bytes), back, width)
        rows = []
        for i in range(b.n):
            x, y = b.offsets[i], b.offsets[i + 1]
            lo, hi = true_runs(gone[x:y])
            kept = b.bytes[x:y][~gone[x:y]].tobytes() if len(lo) else b.text(i)
            rows.append((int((hi - lo).sum()), [{"start": int(p), "end": int(q)} for p, q in zip(lo, hi, strict=True)], kept))
        return pa.table({
            "doc_id": b.doc_id,
            "n_bytes": pa.array(np.diff(b.offsets), pa.int64()),
            "n_removed": pa.array([r[0] for r in rows], pa.int64()),
            "n_spans": pa.array([len(r[1]) for r in rows], pa.int64()),
            "spans": pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept": pa.array([r[2] for r in rows], pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
        })

    return R.finish(blocks, R.repeated_starts(blocks, lay, plan, _stream, match), work, SCHEMA)
