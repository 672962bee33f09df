"""Pairs of token sets with a Jaccard similarity at or above a threshold, found in cells of bounded size.

Sets travel once as arrays of 32-bit hashes. The corpus is cut by set size into groups and slices of at most ``SLICE``
tokens; a set goes to the slices of the sizes that it can match, and a slice with its share of the sets (at most about
``SHARE`` tokens) is a cell. A cell orders tokens by their frequency in the slice, so no table of tokens, no row for each token and no
candidate pair is ever shuffled. Equal sets share a cell, where the one of the least row stands for all.

Nothing is lost by the hashes: tokens of one set that collide are allowed for, and a cell's pairs are a superset of the
true ones, few more; the caller compares those by their strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a corpus slice and of the sets that meet it in one cell. A token takes some 100 bytes of working arrays in a slice, 4 in a share.
SLICE, SHARE = 2 << 20, 8 << 20
#: Tokens of sets, and rows of matching tokens, that a cell works on at once.
STEP = 2 << 20
#: Size bins for each factor of e, so that the driver sees a row for each bin and not for each size.
BINS = 40
EPS = 1e-9


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each entry, n places each."""
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - at, n)


def _lists(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of integer lists."""
    one = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return one.flatten().to_numpy(zero_copy_only=False), np.diff(one.offsets.to_numpy())


def _needed(k: np.ndarray, other: np.ndarray, t: float) -> np.ndarray:
    return np.ceil((k + other) * (t / (1 + t)) - EPS).astype(np.int64)


def _prefix(k: np.ndarray, t: float) -> np.ndarray:
    """Tokens, rarest first, of which a match must share one."""
    return k - np.ceil(k * t - EPS).astype(np.int64) + 1


class Slice:
    """A slice of the corpus: tokens as ranks by frequency, and an inverted index of the rarest of each set."""

    def __init__(self, k: np.ndarray, hashes: np.ndarray, n: np.ndarray, t: float):
        self.k, self.n, self.t = k, n, t
        self.vocab, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int64)
        self.rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.keys = (np.repeat(np.arange(len(n)), n) << 32) | self.rank[place]  # set, rank
        del place
        self.keys.sort()
        first = np.cumsum(n) - n
        head = np.minimum(_prefix(k, t), n)
        self.rest = n - head
        self.last = self.keys[first + head - 1] & 0xFFFFFFFF
        lead = self.keys[_expand(first, head)]
        own = lead >> 32
        self.index = ((lead & 0xFFFFFFFF) << 32) | k[own]  # rank, size
        by = np.argsort(self.index, kind="stable")
        self.index, self.own = self.index[by], own[by]

    def pairs(self, k: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the sets given, places of the slice's sets) that may be similar."""
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        has = self.vocab[at] == hashes
        owner = np.repeat(np.arange(len(n)), n)[has]
        keys = (owner << 32) | self.rank[at[has]]
        keys.sort()
        present = np.bincount(owner, minlength=len(n))
        first = np.cumsum(present) - present
        head = np.clip(_prefix(k, self.t) - (n - present), 0, present)  # tokens that the slice lacks come first
        rest = present - head
        last = np.where(head > 0, keys[np.maximum(first + head - 1, 0)] & 0xFFFFFFFF, -1) if len(keys) else np.full(len(n), -1)
        lead = keys[_expand(first, head)]
        rank, own = (lead & 0xFFFFFFFF) << 32, lead >> 32
        lo = np.searchsorted(self.index, rank | np.ceil(k * self.t - EPS).astype(np.int64)[own])
        hi = np.searchsorted(self.index, rank | np.minimum(np.floor(k / self.t + EPS), 0xFFFFFFFF).astype(np.int64)[own], "right")
        met = hi - lo
        total = np.cumsum(np.append(0, np.bincount(own, met, minlength=len(n)).astype(np.int64)))
        ends = np.cumsum(head)
        a = 0
        while a < len(n):  # runs of sets
            b = max(a + 1, int(np.searchsorted(total, total[a] + STEP, "right")) - 1)
            part = slice(int(ends[a] - head[a]), int(ends[b - 1]))
            here, there = np.repeat(own[part], met[part]), self.own[_expand(lo[part], met[part])]
            both, shared = np.unique((here << 32) | there, return_counts=True)
            here, there = both >> 32, both & 0xFFFFFFFF
            need = _needed(k[here], self.k[there], self.t) - np.minimum((k - n)[here], (self.k - self.n)[there])
            # what isn't counted yet lies beyond the prefix that ends first
            good = shared + np.where(last[here] <= self.last[there], rest[here], self.rest[there]) >= need
            here, there, need = here[good], there[good], need[good]
            sizes = np.cumsum(np.append(0, present[here]))
            x = 0
            while x < len(here):
                y = max(x + 1, int(np.searchsorted(sizes, sizes[x] + STEP, "right")) - 1)
                m = present[here[x:y]]
                probe = (np.repeat(there[x:y], m) << 32) | (keys[_expand(first[here[x:y]], m)] & 0xFFFFFFFF)
                found = self.keys[np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)] == probe
                same = np.bincount(np.repeat(np.arange(y - x), m), found, minlength=y - x)
                ok = same >= need[x:y]
                yield here[x:y][ok], there[x:y][ok]
                x = y
            a = b


def _once(table: pa.Table) -> pa.Table:
    """The row of the least number of each key."""
    code = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    by = np.argsort(table["row"].to_numpy(), kind="stable")
    return table.take(np.sort(by[np.unique(code[by], return_index=True)[1]]))


def _cell(sets: pa.Table, corpus: pa.Table, t: float) -> pa.Table:
    rows, others = [], []
    cell = sets["cell"][0].as_py() if len(sets) else 0
    if len(sets) and len(corpus):
        sets, corpus = _once(sets), _once(corpus)
        values, n = _lists(corpus["h"])
        index = Slice(corpus["k"].to_numpy().astype(np.int64), values, n, t)
        names = corpus["row"].to_numpy()
        for batch in sets.to_batches():
            values, n = _lists(batch.column("h"))
            k, row = batch.column("k").to_numpy().astype(np.int64), batch.column("row").to_numpy()
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + STEP, "right")))
                for here, there in index.pairs(k[a:b], values[ends[a] - n[a] : ends[b - 1]], n[a:b]):
                    rows.append(row[a:b][here])
                    others.append(names[there])
                a = b
    none = [np.zeros(0, np.int64)]
    row = np.concatenate(rows or none)
    return pa.table({"cell": pa.array(np.full(len(row), cell), pa.int64()), "row": pa.array(row, pa.int64()), "other": pa.array(np.concatenate(others or none), pa.int64())})


def _plan(sets: DataFrame, corpus: DataFrame, t: float) -> list[tuple[int, int, int, int, int, int]]:
    """(first cell, slices, shares, smallest and largest size, largest bin) of each group of corpus sizes; the driver sees counts by size bin only."""
    def bins(d: DataFrame) -> list[tuple]:
        return sorted(d.groupBy("bin").agg(F.sum("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect())

    groups = []
    for b, n, lo, hi in bins(corpus):
        if groups and groups[-1][1] + n <= SLICE:
            g = groups[-1]
            groups[-1] = (b, g[1] + n, g[2], hi)
        else:
            groups.append((b, n, lo, hi))
    ours, cores, out, cell = bins(sets), sets.sparkSession.sparkContext.defaultParallelism, [], 0
    for b, n, lo, hi in groups:
        meets = sum(m for _, m, x, y in ours if y >= t * lo - EPS and x * t <= hi + EPS)
        slices, shares = math.ceil(n / SLICE), max(math.ceil(meets / SHARE), min(cores, math.ceil(meets / STEP)))
        if shares:
            out.append((cell, slices, shares, lo, hi, b))
            cell += slices * shares
    return out


def near_rows(sets: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """(cell, row, other): pairs of different sets that may reach the threshold, all true ones among them, each once.

    Both tables have ``row`` (long, unique), ``set`` (different tokens, at least one) and ``key`` (equal for equal sets only); of equal sets of
    a table the least row is given.
    """
    def packed(d: DataFrame) -> DataFrame:
        size = F.size("set")
        return d.select("row", "key", size.alias("k"), F.floor(F.log(size.cast("double")) * BINS).cast("int").alias("bin"), F.array_distinct(F.transform("set", lambda w: F.hash(w))).alias("h"))

    spark, a, b = sets.sparkSession, packed(sets), packed(corpus)
    schema = "cell long, slices int, shares int, lo int, hi int, upto int"
    plan = F.broadcast(spark.createDataFrame(_plan(a, b, threshold), schema))
    some = F.xxhash64("key")
    fits = (F.col("k") >= threshold * F.col("lo") - EPS) & (F.col("k") * threshold <= F.col("hi") + EPS)
    a = a.join(plan, fits).withColumn("at", F.explode(F.expr("transform(sequence(0, slices - 1), s -> cell + s * shares)")))
    a = a.select((F.col("at") + F.pmod(some, F.col("shares"))).alias("cell"), "row", "key", "k", "h")
    b = b.join(plan, F.col("k").between(F.col("lo"), F.col("hi"))).withColumn("at", F.col("cell") + F.pmod(some, F.col("slices")) * F.col("shares"))
    b = b.select(F.explode(F.expr("sequence(at, at + shares - 1)")).alias("cell"), "row", "key", "k", "h")
    work = lambda x, y: _cell(x, y, threshold)
    return a.groupBy("cell").cogroup(b.groupBy("cell")).applyInArrow(work, "cell long, row long, other long")
