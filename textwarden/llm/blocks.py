"""Documents in content-addressed blocks, and exchanges between blocks and hash ranges.

Several operators ask about every n-gram of the corpus how often it occurs anywhere.
Rows for single n-grams would be many times the size of the text, so documents are
first dealt to blocks of a few MB by a hash of their id and text. A block sorts its
distinct 64-bit fingerprints; each hash range ("bucket") receives one compressed,
delta-coded slice from each block, adds up the counts and sends one count for each
fingerprint back. Both groups are bounded: a block by its share of the text (or one
document), a bucket by its share of the hash range, and a fingerprint that occurs in
a third of all rows is one entry of each block's slice.

Blocks and buckets both grow with the corpus, so beyond ``FAN`` buckets slices go in two steps: the blocks of a
superblock (one of about the square root of their number) send slices of coarse ranges, which meet, are added up and only then
cut into buckets. So no task makes or takes more slices than about twice the square root of the number of blocks or buckets.
Beyond TASK_BYTES of text for each of the session's shuffle partitions, blocks and buckets are dealt to more tasks.

A lost executor costs the recomputation of its blocks only: the assignment of rows to
blocks, their order within a block, and so every slice depend on content alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.hashing import U64, Rolling, expand

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
LEAST = 32
#: Buckets up to which a block sends them slices directly; bytes of text for each task that deals with blocks or buckets.
FAN, TASK_BYTES = 2048, 32 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Layout:
    blocks: int
    buckets: int
    tasks: int = 0

    @property
    def steps(self) -> tuple[int, int, int]:
        """Superblocks, coarse ranges, and buckets in each; superblocks are 0 where one step does."""
        if self.buckets <= FAN:
            return 0, self.buckets, 1
        coarse = math.isqrt(self.buckets - 1) + 1
        return math.isqrt(self.blocks - 1) + 1, coarse, -(-self.buckets // coarse)


def dealt(df: DataFrame, lay: Layout, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as the layout asks for, where the session has fewer shuffle partitions."""
    if lay.tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(lay.tasks, *keys)


def layout(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Layout:
    """Counts of blocks and buckets in proportion to the bytes of text (one aggregate row)."""
    n = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return Layout(LEAST + n // block_bytes, LEAST + n // bucket_bytes, n // TASK_BYTES)


def blocked(docs: DataFrame, lay: Layout, id_col: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(block, doc_id, text and the column to carry, if any); the same rows always come to the same block."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *([carry] if carry else []))
    return dealt(d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(lay.blocks)).cast("int").alias("block"), *d.columns), lay, "block")


def pack(a: np.ndarray) -> bytes:
    """zstd over byte planes: high bytes of small numbers cost nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b) if b else b"", np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=U64(0))) if len(a) else pack(a)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


class Block:
    """The documents of one block in a fixed order, as one byte array with offsets."""

    def __init__(self, table: pa.Table):
        t = pa.table({"doc_id": table["doc_id"], "text": table["text"].cast(pa.large_binary())}).combine_chunks()
        self.order = pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")])
        t = t.take(self.order).combine_chunks()
        self.doc_id = t["doc_id"]
        col = t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"]
        col = pc.fill_null(col, b"")
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
        n = self.n = len(col)
        _, off, data = col.buffers()
        self.offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1].copy() if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = raw[self.offsets[0] : self.offsets[-1]]
        self.offsets -= self.offsets[0]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the index of the first word of each document (with the total last)."""
        n = len(self.bytes)
        solid = ~_SPACE[self.bytes]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], solid))
        after = np.concatenate((solid, [False]))
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        return starts, ends, np.searchsorted(starts, self.offsets)

    def text(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def word_hashes(b: Block, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lowered if fold), and word offsets of the documents."""
    data = b.bytes
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = b.words()
    return Rolling(data).of(starts, ends), first


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of the windows of k symbols over n, by start: those that lie in one document."""
    m = max(0, n - k + 1)
    ok = np.zeros(n + 1, bool)
    lengths = np.maximum(np.diff(first) - (k - 1), 0)
    ok[expand(first[:-1], lengths)] = True
    return ok[:m]


def slices(values: np.ndarray, buckets: int, low: int = 0, high: int = 1 << 64) -> np.ndarray:
    """Bounds of even hash ranges (of all, or of a range) in a sorted array of 64-bit values."""
    cuts = np.array([low + (i * (high - low)) // buckets for i in range(1, buckets)], U64)
    return np.concatenate(([0], np.searchsorted(values, cuts), [len(values)]))


def coarse_range(i: int, coarse: int) -> tuple[int, int]:
    """Bounds of a coarse hash range, as :func:`slices` cuts them."""
    return (i << 64) // coarse, ((i + 1) << 64) // coarse


def corpus_counts(blocks: DataFrame, lay: Layout, grams: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(block, bucket, counts): how often each distinct fingerprint of the block occurs in the corpus.

    ``grams`` gives the fingerprints of a block, with repeats. :func:`block_counts` reads the result.
    """
    supers, coarse, fine = lay.steps

    def send(table: pa.Table) -> pa.Table:
        values, counts = np.unique(grams(table), return_counts=True)
        cut = slices(values, coarse)
        full = np.flatnonzero(np.diff(cut))
        block = table["block"][0].as_py() if len(table) else 0
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array(np.full(len(full), block), pa.int32()),
            "keys": pa.array([pack_sorted(values[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
            "counts": pa.array([pack(counts[cut[i] : cut[i + 1]].astype(np.uint32)) for i in full], pa.binary()),
        })

    def add(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = [unpack(x, np.uint32) for x in table["counts"].to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype(np.uint64)
        own = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)[place]
        return pa.table({
            "block": table["block"],
            "bucket": table["bucket"],
            "payload": pa.array([pack(x) for x in np.split(own, ends[:-1])], pa.binary()),
        })

    sent = blocks.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, counts binary")
    if not supers:
        return dealt(sent, lay, "bucket").groupBy("bucket").applyInArrow(add, "block int, bucket int, payload binary")

    def gather(table: pa.Table) -> pa.Table:
        """The slices of a superblock's blocks in one coarse range, added up and cut into buckets."""
        values, counts = _merged(table)
        i = table["bucket"][0].as_py()
        cut = slices(values, fine, *coarse_range(i, coarse))
        full = np.flatnonzero(np.diff(cut))
        return pa.table({
            "bucket": pa.array(i * fine + full, pa.int32()),
            "block": pa.array(np.full(len(full), table["super"][0].as_py()), pa.int32()),
            "keys": pa.array([pack_sorted(values[cut[k] : cut[k + 1]]) for k in full], pa.binary()),
            "counts": pa.array([pack(counts[cut[k] : cut[k + 1]]) for k in full], pa.binary()),
        })

    def spread(table: pa.Table, back: pa.Table) -> pa.Table:
        """The totals of a superblock's coarse range for each of its blocks."""
        if not len(table):
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        values, _ = _merged(table)
        total = block_counts(values, back)
        own = [total[np.searchsorted(values, unpack_sorted(x))] for x in table["keys"].to_pylist()]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "payload": pa.array([pack(x) for x in own], pa.binary())})

    near = dealt(sent.withColumn("super", F.expr(f"block % {supers}")), lay, "super", "bucket")
    gathered = near.groupBy("super", "bucket").applyInArrow(gather, "bucket int, block int, keys binary, counts binary")
    added = dealt(gathered, lay, "bucket").groupBy("bucket").applyInArrow(add, "block int, bucket int, payload binary")
    back = added.select(F.col("block").alias("super"), F.expr(f"bucket div {fine}").cast("int").alias("at"), "bucket", "payload")
    return near.groupBy("super", "bucket").cogroup(back.groupBy("super", "at")).applyInArrow(spread, "block int, bucket int, payload binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of several slices, sorted, and their counts added up."""
    values, place = np.unique(np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([unpack(x, np.uint32) for x in table["counts"].to_pylist()]))
    return values, np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def block_counts(values: np.ndarray, back: pa.Table) -> np.ndarray:
    """Corpus counts of a block's sorted distinct fingerprints, from the rows sent back."""
    order = np.argsort(back["bucket"].to_numpy())
    parts = back["payload"].to_pylist()
    got = np.concatenate([unpack(parts[i], np.uint32) for i in order]) if len(order) else np.zeros(0, np.uint32)
    if len(got) != len(values):
        raise ValueError("counts sent back do not match the block")
    return got
