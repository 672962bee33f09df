"""Substring deduplication of word sequences by relative Lempel-Ziv factors.

All documents are both text and reference. Each hash bucket holds reference blocks (the
distinct segments that share a smallest gram) and an index of them: their sorted suffixes, with the common prefixes of neighbours, which give the
longest match from any place to another. A document's segments are factored greedily: a factor goes as far as the longest match from its start, and
the next begins where it ends. Words in a factor of ``width`` words or more are duplicates. A window over the seam of two
factors may still occur as a whole in another reference, so the windows at each seam are looked up in the index too.

Results for odd input: null or blank text has no words and nothing is removed; repeated rows
(even with the same id) count as other occurrences; ties between sources go to the smaller
neighbour in suffix order, which affects no output; a very long text is judged whole, in a block of its own; extra columns are ignored, as only the
id and text columns are read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm import blocks as B
from textwarden.llm import repeats as R
from textwarden.llm.hashing import covered, expand, true_runs
from textwarden.llm.storage import loosened
from textwarden.llm.suffixes import sorted_suffixes

#: Anchors are 8-word grams, one in 4.
GRAM, EVERY = 8, 4
#: Bytes of text for a bucket: sorting takes some 100 bytes for each word that is left of it.
BUCKET_BYTES = 6 << 20


def longest_matches(body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest match from each place of the segments to any other place: the nearer of the neighbours among the sorted suffixes.

    Matches don't cross the end of a segment; the source is -1 where nothing matches.
    """
    first = np.cumsum(lengths) - lengths
    _, symbol = np.unique(body, return_inverse=True)
    gap = np.repeat(np.arange(len(lengths)), lengths)  # a separator of its own after each segment
    place = np.arange(len(body)) + gap
    text = np.arange(len(body) + len(lengths)) + len(body)
    text[place] = symbol
    order, rank, common = sorted_suffixes(text)
    above, below = np.append(0, common)[rank[place]], np.append(common, 0)[rank[place]]
    size = np.maximum(above, below)
    near = order[np.where(above >= below, rank[place] - 1, np.minimum(rank[place] + 1, len(order) - 1))]
    back = np.full(len(text), -1, np.int64)
    back[place] = np.arange(len(body))
    source = np.where(size > 0, back[near], -1)
    return np.minimum(size, np.repeat(first + lengths, lengths) - np.arange(len(body))), source


def factors(size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts of the greedy factors: each goes as far as the longest match from its start, the next begins at its end; a symbol that matches nothing is a factor of its own."""
    step = np.maximum(size, 1).tolist()
    out, end = [], 0
    for n in lengths.tolist():
        at, end = end, end + n
        while at < end:
            out.append(at)
            at += step[at]
    return np.array(out, np.int64)


def match(body: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows that occur elsewhere: those inside a long factor, and those over a seam of factors that match as a whole."""
    hit = np.zeros(len(body), bool)
    if not len(body):
        return hit
    size, _ = longest_matches(body, lengths)
    start = factors(size, lengths)
    long = start[size[start] >= width]
    hit[expand(long, size[long] - width + 1)] = True
    # a window that no factor holds crosses the start of one: it begins up to width - 1 symbols before
    seam = covered(len(body), np.maximum(start - width + 1, 0), start)
    hit[seam & (size >= width)] = True
    return hit


def _stream(table: pa.Table) -> R.Stream:
    return R.Stream(*B.word_hashes(B.Block(table)))


SCHEMA = "doc_id long, text string, kept string, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Per document: text, kept text, counts, removed spans (in words), the digest of what is kept, and the column ``carry``.

    A word goes if a window of ``width`` words that covers it also starts anywhere else.
    """
    docs = loosened(docs)
    lay = B.layout(docs, text_col, bucket_bytes=BUCKET_BYTES)
    blocks = B.blocked(docs, lay, id_col, text_col, carry)
    plan = R.Plan(width=width, gram=min(GRAM, width), every=EVERY, symbols="uint32")

    def work(docs: pa.Table, back: pa.Table) -> pa.Table:
        b = B.Block(docs)
        _, _, first = b.words()
        gone = R.coverage(int(first[-1]), back, width)
        kept, removed, spans, digest = [], [], [], []
        for i in range(b.n):
            mask = gone[first[i] : first[i + 1]]
            words = b.text(i).split()
            lo, hi = true_runs(mask)
            if len(lo):
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            out = b" ".join(words)
            kept.append(out)
            removed.append(int(mask.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
            digest.append(hashlib.sha256(out).hexdigest())
        return pa.table({
            "doc_id": b.doc_id,
            "text": pa.array([b.text(i) for i in range(b.n)], pa.binary()).cast(pa.string()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept_sha256": pa.array(digest, pa.string()),
            **({carry: docs[carry].take(b.order)} if carry else {}),
        })

    return R.finish(blocks, R.repeated_starts(blocks, lay, plan, _stream, match), work, SCHEMA + (f", {carry} {dict(docs.dtypes)[carry]}" if carry else ""))
