"""Which fixed-length windows of a corpus start more than once: the plan shared by both span deduplicators.

1. Anchors. A content-defined sample of short grams (one in ``every``) is counted over
   the corpus (:func:`blocks.corpus_counts`). A window that holds an anchor seen once can't
   be repeated; what is left is close to the true repeats.
2. Segments. Runs of remaining windows are cut where the smallest gram hash of the window
   changes. That hash is a function of the window's content, so equal windows meet in the same
   bucket. Equal segments of a block are sent once, with their places; the sub-key of a
   segment that holds a very frequent anchor takes the hash of a second, finer gram in, so that
   what differs around a frequent passage is spread over the buckets.
3. Match. In each bucket the distinct segments go to a matcher (greedy factors or a suffix
   array), which says for every window start whether the same window also starts elsewhere.
4. The answers, as ranges of starts, go back to the blocks.

No step samples or caps windows; steps 1 and 2 only split the work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm import blocks as B
from textwarden.llm.hashing import U64, Rolling, covered, expand, mix, sliding_min, true_runs
from textwarden.llm.storage import give_back


@dataclass(frozen=True)
class Plan:
    """width: symbols of a window; gram: of an anchor; every: one gram in so many is an anchor;
    hot: corpus count from which an anchor's segments get a finer key; symbols: dtype sent."""

    width: int
    gram: int
    every: int
    symbols: str
    hot: int = 512


@dataclass
class Stream:
    """A block's symbols (as hashes or bytes) and the first symbol of each document."""

    symbols: np.ndarray
    first: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        return Rolling(self.symbols).windows(k)


def anchors(s: Stream, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors."""
    g = s.grams(plan.gram)
    at = np.flatnonzero((g % U64(plan.every) == 0) & B.inside(s.first, len(s.symbols), plan.gram))
    return at, mix(g[at])


def segments(s: Stream, plan: Plan, counts: pa.Table, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, places of all copies, copies of each, lengths) of the distinct segments with repeated anchors."""
    n, w = len(s.symbols), plan.width
    if n < w:
        return []
    at, hashes = anchors(s, plan)
    values, place = np.unique(hashes, return_inverse=True)
    count = B.block_counts(values, counts)[place] if len(values) else np.zeros(0, np.uint32)
    lone = np.zeros(n + 1, np.int32)
    lone[at[count < 2] + 1] = 1
    lone = np.cumsum(lone, dtype=np.int32)
    hot = np.zeros(n + 1, np.int32)
    hot[at[count >= plan.hot] + 1] = 1
    hot = np.cumsum(hot, dtype=np.int32)
    span = w - plan.gram + 1
    left = (lone[span : n - w + 1 + span] == lone[: n - w + 1]) & B.inside(s.first, n, w)
    lo, hi = true_runs(left)
    del lone, left
    if not len(lo):
        return []
    g = s.grams(plan.gram)
    # all runs at once: their grams, laid end to end, are minimised and windows across a seam left out
    size = hi - lo
    window = expand(lo, size)
    seam = expand(np.cumsum(size + span - 1) - (size + span - 1), size)
    key = sliding_min(g[expand(lo, size + span - 1)], span)[seam]
    wide = w - max(2, plan.gram // 4) + 1
    tail = min(wide, max(4, plan.gram * 2))
    busy = hot[window + span] > hot[window]
    if busy.any():
        fine = mix(s.grams(max(2, plan.gram // 4)))
        low = sliding_min(fine, tail)
        del fine
        for side in (0, wide - tail):  # the finest gram of the window's first and last part
            key = np.where(busy, mix(key ^ low[np.minimum(window + side, len(low) - 1)]), key)
    new = np.ones(len(window), bool)
    new[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1)
    begins = window[new]
    ends = window[np.flatnonzero(np.append(new[1:], True))] + w
    keys = key[new]
    roll = Rolling(s.symbols)
    same = roll.of(begins, ends)
    # distinct segments, each with the places of its copies
    order = np.lexsort((begins, same, keys))
    begins, ends, keys, same = begins[order], ends[order], keys[order], same[order]
    head = np.ones(len(order), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (same[1:] != same[:-1])
    heads = np.flatnonzero(head)
    copies = np.diff(np.append(heads, len(order)))
    bucket = ((mix(keys[heads]) >> U64(33)) % U64(buckets)).astype(np.int64)
    out = []
    by = np.argsort(bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        out.append((int(bucket[part[0]]), begins[expand(heads[part], copies[part])], copies[part], (ends - begins)[heads[part]]))
    return out


def repeated_starts(blocks: DataFrame, lay: B.Layout, plan: Plan, stream: Callable[[pa.Table], Stream], match: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """(block, ranges): starts, as places in the block's stream, of windows that occur more than once."""
    buckets, dtype = lay.buckets, np.dtype(plan.symbols)
    counts = B.corpus_counts(blocks, lay, lambda t: anchors(stream(t), plan)[1])

    def send(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({k: pa.array([], v) for k, v in (("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.list_(pa.binary())))})
        give_back()
        s = stream(docs)
        rows = []
        for bucket, places, copies, lengths in segments(s, plan, back, buckets):
            lead = places[np.cumsum(copies) - copies]
            body = s.symbols[expand(lead, lengths)].astype(dtype)
            rows.append((bucket, [B.pack(np.array([len(lead), len(places)], np.uint32)), B.pack(places.astype(np.uint32)), B.pack(copies.astype(np.uint32)), B.pack(lengths.astype(np.uint32)), B.zstandard.ZstdCompressor(level=1).compress(body.tobytes())]))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "block": pa.array([docs["block"][0].as_py()] * len(rows), pa.int32()),
            "data": pa.array([r[1] for r in rows], pa.list_(pa.binary())),
        })

    def find(table: pa.Table) -> pa.Table:
        give_back()
        per_block = {"block": [], "ranges": []}
        places, copies, lengths, bodies, owner = [], [], [], [], []
        for block, data in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True):
            places.append(B.unpack(data[1], np.uint32))
            copies.append(B.unpack(data[2], np.uint32).astype(np.int64))
            lengths.append(B.unpack(data[3], np.uint32).astype(np.int64))
            bodies.append(np.frombuffer(B.zstandard.ZstdDecompressor().decompress(data[4]), dtype))
            owner.append(np.full(len(lengths[-1]), block))
        size, times, who = np.concatenate(lengths), np.concatenate(copies), np.concatenate(owner)
        body = np.concatenate(bodies)
        spot = np.cumsum(size) - size
        # the same segment from several blocks: one goes to the matcher
        same = Rolling(body).of(spot, spot + size)
        _, lead, group = np.unique(same, return_index=True, return_inverse=True)
        total = np.bincount(group, times)
        kept = body[expand(spot[lead], size[lead])]
        hit = match(kept, size[lead], plan.width)
        base = np.cumsum(size[lead]) - size[lead]
        all_places = np.concatenate(places).astype(np.int64)
        cut = np.cumsum(times) - times
        n_windows = size[lead] - plan.width + 1
        for i in np.flatnonzero(total > 1):
            hit[base[i] : base[i] + n_windows[i]] = True
        # ranges of each distinct segment, then of each copy
        lo, hi = true_runs(hit)
        seg = np.searchsorted(base, lo, "right") - 1
        per = np.bincount(seg, minlength=len(lead))
        at = np.cumsum(per) - per
        n = per[group]
        r = expand(at[group], n)
        seg_lo, seg_hi = (lo - base[seg])[r], (hi - base[seg])[r]
        copy_of = np.repeat(np.arange(len(size)), times)
        k = n[copy_of]
        pick = expand((np.cumsum(n) - n)[copy_of], k)
        origin = np.repeat(all_places[expand(cut, times)], k)
        blocks_of = np.repeat(who[copy_of], k)
        starts, stops = origin + seg_lo[pick], origin + seg_hi[pick]
        order = np.argsort(blocks_of, kind="stable")
        starts, stops, blocks_of = starts[order], stops[order], blocks_of[order]
        bounds = np.flatnonzero(np.diff(blocks_of)) + 1
        if len(blocks_of):
            for a, b, bl in zip(np.split(starts, bounds), np.split(stops, bounds), blocks_of[np.append(0, bounds)], strict=True):
                per_block["block"].append(int(bl))
                per_block["ranges"].append(B.pack(np.concatenate((a, b)).astype(np.uint32)))
        return pa.table({"block": pa.array(per_block["block"], pa.int32()), "ranges": pa.array(per_block["ranges"], pa.binary())})

    sent = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(send, "bucket int, block int, data array<binary>")
    return B.dealt(sent, lay, "bucket").groupBy("bucket").applyInArrow(find, "block int, ranges binary")


def coverage(n: int, back: pa.Table, width: int) -> np.ndarray:
    """Which of a stream's n symbols lie in a repeated window."""
    parts = [B.unpack(x, np.uint32).astype(np.int64) for x in back["ranges"].to_pylist()]
    lo = np.concatenate([p[: len(p) // 2] for p in parts]) if parts else np.zeros(0, np.int64)
    hi = np.concatenate([p[len(p) // 2 :] for p in parts]) if parts else lo
    return covered(n, lo, hi + width - 1)


def finish(blocks: DataFrame, ranges: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    def one(docs: pa.Table, back: pa.Table) -> pa.Table:
        give_back()
        return work(docs, back)

    return blocks.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(one, schema)


