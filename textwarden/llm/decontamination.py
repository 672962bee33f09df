"""Benchmark decontamination: edit-distance search by CGK embedding and bit-sampling LSH.

Texts and items are sequences of lower-case words. Over every document slide windows as long as
an item (a document's end is padded, so shorter copies are met too). A window is contaminated
by an item if their word edit distance is at most (1 - ``similarity``) of the item's length.

1. A window within that distance has at least ``similarity`` of its words in common
   with the item, so windows with fewer words from the items of that length (by running sums, and, where these are
   few, from each of them) are left out; so are windows whose neighbouring words differ in fewer places
   than the items' less two for each edit. Both tests lose nothing.
2. The CGK random walk maps the rest and the items to strings in which edit distance shows
   as Hamming distance: step j emits the word at the cursor, which moves on by one hashed bit of (j, word).
3. ``tables`` walks sample ``bits`` places each; a window that agrees with an item on all
   places of a walk is a candidate. With places that agree with probability p, a match is met with
   probability 1 - (1 - p^bits)^tables; :func:`tables_for` gives the number for a target recall.
4. Candidates are verified by exact edit distance.

Items are searched in chunks of bounded size. One pass over the documents serves a chunk; where there are several, each pass
is run and its few hits are written to the shared folder before the next chunk is read, so neither the driver nor a task holds
more than one chunk, whatever the size of the benchmark.

Results for odd input: null or blank text has no words and isn't contaminated; items without words or
without an id match nothing; ids are of any type that sorts; equal items are all reported; repeated rows are judged alike; ties for the best similarity
don't affect the ids reported; a very long text is searched piece by piece, with overlaps; extra columns are kept by :func:`find`,
which replaces one named ``matches``; an empty table of documents or items gives no match.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textwarden.llm.hashing import mix
from textwarden.llm.storage import give_back, loosened, stored

SIMILARITY = 0.8
BITS, AGREE, RECALL = 3, 0.5, 0.97
#: Up to so many items of one length, windows are tested for common words with each.
EACH = 64
#: Words of all items that one pass holds.
CHUNK_WORDS = 2_000_000
#: Words of text worked on at once, and windows embedded at once.
PIECE, WINDOWS = 1 << 18, 1 << 13

_WORD = re.compile(r"\w+")


def tables_for(recall: float, agree: float, bits: int) -> int:
    return int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits)))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def sampled_places(table: int, length: int, bits: int) -> np.ndarray:
    """Places of the walk over a window of ``length`` words that a table looks at, in order."""
    rng = np.random.default_rng([table, length])
    return np.sort(rng.choice(2 * length, size=min(bits, 2 * length), replace=False))


def embed(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys (tables x rows) of the rows of x (word numbers): the CGK symbols at each table's places, hashed together.

    All tables walk at once; whether a cursor moves on is one hashed bit of table, step and symbol.
    """
    n, length = x.shape
    tables = len(places)
    padded = np.concatenate((x, np.full((n, 1), -1, x.dtype)), axis=1).ravel()
    row = np.arange(n) * (length + 1)
    at = np.zeros((tables, n), np.int64)
    key = np.repeat(np.arange(tables, dtype=np.uint64)[:, None], n, axis=1)
    own = np.arange(tables, dtype=np.uint64) * np.uint64(0x1000003)
    for j in range(int(places.max()) + 1):
        s = padded[row + at]
        for t in np.flatnonzero((places == j).any(axis=1)):
            key[t] = mix(key[t] * np.uint64(31) + (s[t] + 2).astype(np.uint64))
        salt = mix(own + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[:, None]
        at = np.minimum(at + (mix(salt ^ s.astype(np.uint64)) & np.uint64(1)).astype(np.int64), length)
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distances of the rows of a and b (equal lengths), exact up to ``most``."""
    n, length = a.shape
    far = most + 1
    row = np.full((length + 1, n), far, np.int32)
    row[: most + 1] = np.arange(min(most, length) + 1)[:, None]
    for i in range(1, length + 1):
        lo, hi = max(1, i - most), min(length, i + most)
        last, up = row[lo - 1].copy(), None
        row[lo - 1] = i if lo == 1 else far
        for j in range(lo, hi + 1):
            up = row[j].copy()
            row[j] = np.minimum(np.minimum(row[j - 1], up) + 1, last + (a[:, i - 1] != b[:, j - 1]))
            last = up
    return row[length]


class Index:
    """A chunk of items, prepared on the driver and sent with the task."""

    def __init__(self, items: list[tuple[object, list[str]]], similarity: float, tables: int, bits: int):
        vocab = sorted({w for _, ws in items for w in ws})
        self.vocab = {w: i + 1 for i, w in enumerate(vocab)}
        self.similarity, self.tables, self.bits = similarity, tables, bits
        by = {}
        for item, ws in items:
            by.setdefault(len(ws), []).append((item, [self.vocab[w] for w in ws]))
        self.by_length = []
        for length, group in sorted(by.items()):
            x = np.array([ids for _, ids in group], np.int32)
            member = np.zeros(len(vocab) + 1, np.int8)
            member[x.ravel()] = 1
            changes = int((x[:, 1:] != x[:, :-1]).sum(axis=1).min()) - 2 * self.most(length)
            self.by_length.append((length, [i for i, _ in group], x, member, changes))
        self.longest = max(by, default=0)
        self.keys = None

    def most(self, length: int) -> int:
        return int(np.floor((1 - self.similarity) * length + 1e-9))

    def prepare(self) -> None:
        """Per length: the tables' places and the items' sorted keys; made once in each worker."""
        if self.keys is not None:
            return
        self.keys, self.bags = {}, {}
        for length, _, x, member, _ in self.by_length:
            each = np.zeros((len(x) if len(x) <= EACH else 0, len(member)), np.int8)
            each[np.arange(len(each))[:, None], x[: len(each)]] = 1
            self.bags[length] = each
            places = np.stack([sampled_places(t, length, self.bits) for t in range(self.tables)])
            keys = embed(x, places)
            order = np.argsort(keys, axis=1, kind="stable")
            self.keys[length] = places, np.take_along_axis(keys, order, axis=1), order

    def search(self, ids: np.ndarray, seen: dict[str, int] | None = None) -> list[tuple[int, int, object, int]]:
        """(place, length, item, distance) of all verified windows of a sequence of word numbers (0: in no item).

        ``seen`` adds up windows, those left by the tests for common words, and the pairs that walks leave.
        """
        self.prepare()
        out, seen = [], {} if seen is None else seen
        known = np.concatenate(([0], np.cumsum(ids > 0, dtype=np.int32)))
        changed = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1], dtype=np.int32)))
        for length, items, x, member, least in self.by_length:
            n = len(ids) - length + 1
            if n <= 0:
                continue
            need = length - self.most(length)
            start = np.flatnonzero(known[length:] - known[:n] >= need)
            seen["windows"] = seen.get("windows", 0) + n
            if not len(start):
                continue
            of_length = np.concatenate(([0], np.cumsum(member[ids], dtype=np.int32)))
            start = start[of_length[start + length] - of_length[start] >= need]
            start = start[changed[start + length - 1] - changed[start] >= least]
            if not len(start):
                continue
            for part in np.array_split(start, -(-len(start) // WINDOWS)):
                rows = ids[part[:, None] + np.arange(length)]
                if len(self.bags[length]):
                    ok = np.zeros(len(part), bool)
                    for m in self.bags[length]:
                        left = np.flatnonzero(~ok)
                        ok[left] = m[rows[left]].sum(axis=1, dtype=np.int32) >= need
                    part, rows = part[ok], rows[ok]
                seen["alike"] = seen.get("alike", 0) + len(part)
                if not len(part):
                    continue
                found = []
                places, all_keys, orders = self.keys[length]
                for key, keys, order in zip(embed(rows, places), all_keys, orders, strict=True):
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    times = hi - lo
                    w = np.repeat(np.arange(len(part)), times)
                    pick = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
                    found.append(w * len(items) + order[pick])
                pairs = np.unique(np.concatenate(found))
                seen["pairs"] = seen.get("pairs", 0) + len(pairs)
                for some in np.array_split(pairs, max(1, -(-len(pairs) // WINDOWS))):
                    w, i = some // len(items), some % len(items)
                    d = edit_distances(rows[w], x[i], self.most(length))
                    hit = d <= self.most(length)
                    out += [(int(part[a]), length, items[b], int(c)) for a, b, c in zip(w[hit], i[hit], d[hit], strict=True)]
        return out


def _chunks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in chunks of bounded size; the driver holds one at a time."""
    chunk, size = [], 0
    for r in items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        ws = words(r[1])
        if not ws:
            continue
        chunk.append((r[0], ws))
        size += len(ws)
        if size >= CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _scan(docs: DataFrame, index: Index, id_type: T.DataType) -> DataFrame:
    names = docs.columns
    id_kind = to_arrow_type(id_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocab.get
        gap = index.most(index.longest) + 1
        give_back()
        for batch in batches:
            texts = batch.column(names.index("text"))
            hits: list[list] = [[] for _ in range(len(batch))]
            seq: list[int] = []
            bounds: list[tuple[int, int, int, int]] = []  # first and last place, document, its word at the first place

            def flush() -> None:
                starts = np.array([b[0] for b in bounds])
                stops = np.array([b[1] for b in bounds])
                for place, length, item, d in index.search(np.array(seq, np.int32)):
                    # a window that starts in the padding before a document belongs to it
                    k = int(np.searchsorted(stops, place, "right"))
                    _, _, i, first = bounds[k]
                    hits[i].append((max(place, int(starts[k])) - int(starts[k]) + first, length, item, d))
                seq.clear()
                bounds.clear()

            for i in range(len(batch)):
                ws = words(texts[i].as_py())
                # a very long document goes piece by piece, with an item's length of overlap
                for a in range(0, len(ws), PIECE):
                    seq.extend([0] * gap)
                    ids = [get(w, 0) for w in ws[a : a + PIECE + index.longest]]
                    bounds.append((len(seq), len(seq) + len(ids), i, a))
                    seq.extend(ids)
                    if len(seq) >= PIECE:
                        seq.extend([0] * gap)
                        flush()
            if seq:
                seq.extend([0] * gap)
                flush()
            out = [[{"start": s, "end": s + n, "item": item, "similarity": 1 - d / n} for s, n, item, d in sorted(set(h))] for h in hits]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", id_kind), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*names, "_hits"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in docs.dtypes)
    return docs.mapInArrow(work, f"{kinds}, _hits {_matches(id_type)}")


def _matches(id_type: T.DataType) -> str:
    return f"array<struct<start:bigint,end:bigint,item:{id_type.simpleString()},similarity:double>>"


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bits: int = BITS, agree: float = AGREE, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of docs and ``matches``: (start, end, item, similarity) of all windows of words that match an item."""
    docs, id_type = loosened(docs.drop("_hits", "matches")), items.schema[item_id].dataType
    tables = tables_for(recall, agree, bits)
    chunks = _chunks(items, item_id, item_text)
    first, second = next(chunks, None), next(chunks, None)
    if first is None:
        return docs.withColumn("matches", F.expr(f"cast(array() AS {_matches(id_type)})"))
    if second is None:
        return _scan(docs, Index(first, similarity, tables, bits), id_type).withColumnRenamed("_hits", "matches")
    # several chunks: a pass for each, which leaves its hits by the text's digest
    texts, parts = docs.select("text"), []
    for chunk in itertools.chain((first, second), chunks):
        first = second = None
        hits = _scan(texts, Index(chunk, similarity, tables, bits), id_type).where("size(_hits) > 0").select(F.sha2("text", 256).alias("_digest"), "_hits").dropDuplicates(["_digest"])
        parts.append(stored(hits, "hits"))
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("_digest").agg(F.sort_array(F.flatten(F.collect_list("_hits"))).alias("matches"))
    joined = docs.join(found, F.sha2("text", 256) == F.col("_digest"), "left").drop("_digest")
    return joined.withColumn("matches", F.coalesce("matches", F.expr(f"cast(array() AS {_matches(id_type)})")))


def summary(found: DataFrame) -> DataFrame:
    return found.selectExpr(
        "doc_id", "size(matches) > 0 AS contaminated",
        "sort_array(array_distinct(transform(matches, m -> m.item))) AS item_ids",
        "coalesce(array_max(transform(matches, m -> m.similarity)), 0D) AS best_similarity",
    ).selectExpr("doc_id", "contaminated", "cast(size(item_ids) AS bigint) AS n_items", "item_ids", "best_similarity")
