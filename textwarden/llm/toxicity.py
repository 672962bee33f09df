"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's probability is the
logistic of a sum of weights of its hashed words (runs of letters and digits, A-Z and Latin-1
capitals lowered); the document's is the noisy-or of its sentences', 1 - prod(1 - p). Weights
are trained through the noisy-or by Adagrad, so a toxic label moves the sentences that
explain it, and the sentence scores locate the offending ones.

The fit uses at most about ``per_class`` labelled documents of each class, those of smallest hash of
the id, of at most ``max_bytes`` bytes each and ``most_words`` words in all, weighted back to the shares of the classes.
Texts are hashed in the tasks; the driver holds the hashed words only.
Every text is scored whole, however long.

Results for odd input: null or empty text has no sentence and score 0.0; a document with several
labels takes the largest; labels without a document or with a null class are ignored; repeated rows
are scored alike; ties for the worst sentence go to the first; extra columns are kept by
:func:`score`, which replaces those with the names of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.hashing import Rolling
from textwarden.llm.storage import loosened

BITS = 18
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 18
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentence_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of the sentences: 0 and what follows a run of closing marks or line ends."""
    if not len(raw):
        return np.zeros(0, np.int64)
    end = _END[raw]
    return np.concatenate(([0], np.flatnonzero(end[:-1] & ~end[1:]) + 1))


def fold(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 (lead byte C3) lowered."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    second = np.zeros(len(raw), bool)
    second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[second] += 32
    return out


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashed slots of all words."""
    places, slots, a = [], [], 0
    while a < len(raw):
        b = min(len(raw), a + PIECE)
        while b < len(raw) and _LETTER[raw[b]] and _LETTER[raw[b - 1]]:  # up to the end of a word
            b += 1
        data = fold(raw[a:b])
        step = np.diff(np.concatenate(([0], _LETTER[data].view(np.int8), [0])))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        places.append(start + a)
        slots.append((Rolling(data).of(start, end) >> np.uint64(64 - BITS)).astype(np.int32))
        a = b
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(slots)) if places else (none, none.astype(np.int32))


def _bag(text: bytes) -> tuple[bytes, bytes] | None:
    """Hashed words and the number of words of each sentence that has any; None without words."""
    raw = np.frombuffer(text, np.uint8)
    place, slot = words(raw)
    if not len(place):
        return None
    _, size = np.unique(np.searchsorted(sentence_starts(raw), place, "right"), return_counts=True)
    return slot.astype(np.int32).tobytes(), size.astype(np.int32).tobytes()


def _bags(docs: DataFrame, chosen: DataFrame, max_bytes: int, most_words: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(sentence of each word, hashed words, label) of the chosen documents in order of draw, as far as ``most_words`` go.

    Texts are hashed where they are; the driver reads a few documents at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_bag(t) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            keep = [i for i, m in enumerate(made) if m]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array([made[i][0] for i in keep], pa.binary()), pa.array([made[i][1] for i in keep], pa.binary())],
                ["doc_id", "toxic", "slots", "sizes"],
            )

    rows = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes)).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, slots binary, sizes binary")
    # of rows that share an id one, whichever way they come
    one = rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "slots", "sizes")).alias("bag")).select(_draw(), "doc_id", "bag.*").orderBy("draw", "doc_id")
    out, total = [], 0
    for r in one.toLocalIterator():
        slot, size = np.frombuffer(bytes(r.slots), np.int32), np.frombuffer(bytes(r.sizes), np.int32)
        total += len(slot)
        if total > most_words:
            break
        out.append((r.doc_id, np.repeat(np.arange(len(size), dtype=np.int32), size), slot, r.toxic))
    return [x[1:] for x in sorted(out, key=lambda x: x[0])]


def _draw() -> Column:
    return (F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 12000, max_bytes: int = 65536, most_words: int = 1 << 24, epochs: int = 10, least_gain: float = 14.0, seed: int = 5) -> tuple[np.ndarray, float] | None:
    """Weights and bias from documents and (doc_id, toxic) rows."""
    each = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r.toxic: r.n for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic IN (0, 1)").collect()}
    if len(size) < 2:
        return None
    rate = {c: min(1.0, per_class / n) for c, n in size.items()}
    chosen = each.select("doc_id", "toxic", _draw()).where(F.col("toxic").isin(0, 1) & (F.col("draw") < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))).orderBy("draw", "doc_id").limit(2 * per_class + 1000)
    # chosen has at most 2 * per_class + 1000 rows
    bags = _bags(docs, chosen, max_bytes, most_words)
    if len({x[2] for x in bags}) < 2:
        return None
    y = np.array([x[2] for x in bags])
    weight = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    weight = weight / weight.mean()
    # words that go with the label; the rest would only let training learn documents by heart
    in_pos, in_neg = (np.bincount(np.concatenate([np.unique(x[1]) for x in bags if x[2] == c]), minlength=1 << BITS) for c in (1, 0))
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    both = in_pos + in_neg
    share = n_pos / (n_pos + n_neg)
    gain = 2 * sum(k * np.log(np.maximum(k, 1e-9) / np.maximum(both * q, 1e-9)) for k, q in ((in_pos, share), (in_neg, 1 - share)))
    usable = (gain >= least_gain) & (both >= 3)
    odds = np.log((in_pos + 0.5) / (n_pos + 1)) - np.log((in_neg + 0.5) / (n_neg + 1))
    w = np.where(usable, np.clip(2 * odds, -2, 10), 0).astype(np.float32)
    bias = -9.0
    seen, seen_b = np.full(1 << BITS, 1e-3, np.float32), 1e-3
    rate_w = 0.05
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 32)):
            base, owner, idx, slot = 0, [], [], []
            for d in part:
                s, h, _ = bags[d]
                owner.append(np.full(s[-1] + 1, len(owner)))
                idx.append(s + base)
                slot.append(h)
                base += int(s[-1]) + 1
            owner, idx, slot = np.concatenate(owner), np.concatenate(idx), np.concatenate(slot)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(idx, w[slot], minlength=base) + bias, -30, 30)))
            none = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(part)))
            pos = y[part] == 1
            pull = np.where(pos, -none / np.maximum(1 - none, 1e-9), 1.0) * weight[part]
            g = (pull[owner] * p / len(part)).astype(np.float32)
            grad = np.bincount(slot, g[idx], minlength=1 << BITS).astype(np.float32)
            at = np.flatnonzero((grad != 0) & usable)
            step = grad[at] + 1e-5 * w[at]
            seen[at] += step * step
            w[at] -= rate_w * step / np.sqrt(seen[at])
            gb = float(g.sum())
            seen_b += gb * gb
            bias -= rate_w * gb / np.sqrt(seen_b)
    return w, bias


def sentence_scores(raw: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the sentences and their probabilities."""
    starts = sentence_starts(raw)
    place, slot = words(raw)
    z = bias + np.bincount(np.searchsorted(starts, place, "right") - 1, w[slot], minlength=len(starts))
    return starts, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs (text only if it is among ``docs``), toxic_score, n_sentences, and the spans, in bytes, of offending sentences."""
    docs = loosened(docs.drop("toxic_score", "n_sentences", "offending"))
    names = docs.columns
    w, bias = model if model else (np.zeros(1 << BITS, np.float32), -30.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text")).cast(pa.large_binary())
            scores, count, spans = np.zeros(len(batch)), np.zeros(len(batch), np.int64), []
            for i in range(len(batch)):
                raw = np.frombuffer(text[i].as_py() or b"", np.uint8)
                hit = []
                if len(raw):
                    starts, p = sentence_scores(raw, w, bias)
                    scores[i], count[i] = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()), len(p)
                    stops = np.append(starts[1:], len(raw))
                    hit = [{"start": int(starts[j]), "end": int(stops[j]), "score": float(p[j])} for j in np.flatnonzero(p >= threshold)]
                spans.append(hit)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(count), pa.array(spans, kind)], [*names, "toxic_score", "n_sentences", "offending"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in docs.dtypes)
    return docs.mapInArrow(work, f"{kinds}, toxic_score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>")
