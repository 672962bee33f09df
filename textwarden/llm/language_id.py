"""Language identification with error-correcting output codes.

Each language gets a codeword; one binary classifier per code bit (ridge regression on hashed
byte n-grams, fitted in its dual form or, for many rows, its primal one) says on which side of the bit a text lies. Decoding adds up,
per language, the losses of all bits against its codeword, each weighted by that bit's
accuracy on the language's training texts, and takes the language of least loss. A text is
ambiguous where the runner-up is within ``margin``.

The fit uses at most ``per_lang`` texts of a language, and of all languages about ``most`` (with many languages fewer of
each, never fewer languages), chosen by a hash of id and text; of a text above ``max_bytes`` bytes it learns a stretch
from a hashed place. These are parameters of :func:`fit`. Every text is scored whole, a very long one in pieces.

Results for odd input: null text or text without a letter gives ``und`` and score 0.0;
ties between languages go to the first in code-point order; without any
labelled row everything is ``und``; repeated rows are judged alike; extra columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.blocks import _SPACE
from textwarden.llm.storage import removed, stored

BITS = 13
ORDERS = (2, 3, 4)
#: Texts are hashed in pieces of so many bytes.
PIECE = 1 << 18

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray  # languages x bits, +-1
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # languages x bits, rows sum to 1


def vector(text: bytes) -> np.ndarray:
    """Unit vector of the square roots of hashed byte n-gram counts."""
    out = np.zeros(1 << BITS)
    look = max(ORDERS)
    for a in range(0, max(len(text), 1), PIECE):
        b = _FOLD[np.frombuffer(text[a : a + PIECE + look - 1], np.uint8)]
        own = min(PIECE, len(text) - a)
        key = b.copy()
        for k in range(2, look + 1):
            if len(b) < k:
                break
            key = (key[:-1] << np.uint64(8)) | b[k - 1 :]
            if k in ORDERS:
                h = ((key[:own] + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                out += np.bincount(h.astype(np.int64), minlength=1 << BITS)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """Exhaustive codes up to 7 languages, else random ones of 10 log2 k bits, the farthest apart of 64 draws without a constant column."""
    if k <= 7:
        rows = [[1] * max(1, (1 << (k - 1)) - 1)]
        for i in range(1, k):
            rows.append([1 if (j >> (k - 1 - i)) & 1 else -1 for j in range(max(1, (1 << (k - 1)) - 1))])
        return np.array(rows, np.float32)
    rng = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(64):
        c = rng.choice(np.array([-1, 1], np.float32), (k, int(np.ceil(10 * np.log2(k)))))
        d = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
        if d > far and (np.abs(c.sum(0)) < k).all():
            best, far = c, d
    return best


#: Rows up to which ridge regression is solved in its dual form; passes of the primal solver.
DUAL, PASSES = 4096, 200
#: Rows of the table of languages that may be sent to every task.
BROADCAST_LANGS = 10_000


def _sample(labelled: DataFrame, per_lang: int, max_bytes: int, most: int) -> DataFrame | None:
    """lang and text of the texts to learn from: of each language the first by a hash of id and text; of a longer text a stretch at a hashed place."""
    hashed = lambda tag: F.pmod(F.xxhash64(F.lit(tag), F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    usable = labelled.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "text", "lang", hashed("language").alias("_draw"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_draw").alias("_least"))  # a row for each language
    k = sizes.count()
    if not k:
        return None
    per = max(8, min(per_lang, most // k))
    # far more than per are drawn of a language with more, so that what is moved and sorted stays small
    drawn = usable.join(F.broadcast(sizes) if k <= BROADCAST_LANGS else sizes, "lang").where(f"_draw * _n < {4 * per + 64} OR _draw = _least")
    ranked = drawn.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY _draw, doc_id, text) AS _place").where(f"_place <= {per}")
    wide = max_bytes // 4
    at = F.floor(hashed("place") * F.greatest(F.length("text") - wide, F.lit(0))).cast("int")
    cut = ranked.withColumn("_piece", F.when(F.octet_length("text") > max_bytes, F.substring("text", at + 1, F.lit(wide))).otherwise(F.col("text")))
    lettered = F.when(F.col("_piece").rlike(r"\p{L}"), F.col("_piece")).otherwise(F.substring("text", F.regexp_instr("text", F.lit(r"(\p{L})")), F.lit(wide)))
    return cut.select("lang", lettered.alias("text"))


def _batches(chosen: DataFrame, langs: tuple[str, ...], codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, labels and code bits of some hundred rows at a time."""
    index, held = {lang: i for i, lang in enumerate(langs)}, []

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = np.array([index[r.lang] for r in held])
        return np.stack([vector(r.text.encode()) for r in held]), label, codes[label]

    for r in chosen.toLocalIterator():
        held.append(r)
        if len(held) == 256:
            yield out()
            held.clear()
    if held:
        yield out()


def ridge_dual(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights that minimise the squares over cost plus 0.05 times the squared weights, by a matrix of rows x rows."""
    inner = x @ x.T
    inner[np.diag_indices(len(x))] += (0.05 * cost).astype(np.float32)
    return x.T @ np.linalg.solve(inner, y)


def ridge_primal(gram: np.ndarray, right: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """The same weights from the features' products, by conjugate gradients in place of a copy of the matrix."""
    w = np.zeros_like(right)
    rest = right.copy()
    step, size = rest.copy(), (rest * rest).sum(0)
    for _ in range(passes):
        if (size < 1e-10).all():
            break
        along = gram @ step + np.float32(0.05) * step
        far = size / np.maximum((step * along).sum(0), 1e-30)
        w += far * step
        rest -= far * along
        new = (rest * rest).sum(0)
        step, size = rest + new / np.maximum(size, 1e-30) * step, new
    return w


def fit(labelled: DataFrame, per_lang: int = 500, max_bytes: int = 16384, most: int = 32_000, ridge: float = 1.0, dual: int = DUAL) -> Model | None:
    """A model from (doc_id, text, lang) rows. The driver reads the chosen texts a few at a time, and holds one matrix of features or of rows."""
    chosen = _sample(labelled, per_lang, max_bytes, most)
    if chosen is None:
        return None
    chosen = stored(chosen.repartition(8, "lang", "text").sortWithinPartitions("lang", "text"), "languages")
    counts = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, rows = tuple(sorted(counts)), sum(counts.values())
    codes = codewords(len(langs))
    cost = np.array([ridge * rows / (len(langs) * counts[lang]) for lang in langs])  # each language counts alike
    if rows <= dual:
        parts = list(_batches(chosen, langs, codes))
        x, label, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        weights = ridge_dual(x, y, cost[label])
        parts = [(x, label, y)]
    else:
        gram, right = np.zeros((1 << BITS, 1 << BITS), np.float32), np.zeros((1 << BITS, codes.shape[1]), np.float32)
        for x, label, y in _batches(chosen, langs, codes):
            scaled = x / cost[label].astype(np.float32)[:, None]
            right += scaled.T @ y
            for a in range(0, 1 << BITS, 1024):
                gram[a : a + 1024] += scaled[:, a : a + 1024].T @ x
        weights = ridge_primal(gram, right)
        del gram
        parts = _batches(chosen, langs, codes)
    hits = np.zeros(codes.shape)
    for x, label, y in parts:
        np.add.at(hits, label, x @ weights * y > 0)
    removed(chosen)
    trust = hits / np.array([counts[lang] for lang in langs])[:, None] + 1e-6
    return Model(langs, codes, weights.astype(np.float32), (trust / trust.sum(1, keepdims=True)).astype(np.float32))


def decode(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its probability, and the gap in loss to the runner-up, per row of x."""
    margin = np.clip(x @ m.weights, -2, 2)
    loss = np.stack([(np.exp(-margin * m.codes[i]) * m.trust[i]).sum(1) for i in range(len(m.langs))], axis=1)
    best = loss.argmin(1)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    two = np.sort(loss, axis=1)[:, :2]
    return best, 1 / p.sum(1), two[:, -1] - two[:, 0] if len(m.langs) > 1 else np.full(len(x), np.inf)


def predict(docs: DataFrame, model: Model | None, margin: float = 0.1, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the extra columns, lang_pred, score, ambiguous."""
    named = list(extra or {})
    d = docs.select("doc_id", *[c.alias(k) for k, c in (extra or {}).items()], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_has"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                has = np.array(part["_has"].to_pylist(), bool)
                lang, score, unsure = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                at = np.flatnonzero(has)
                if model and len(at):
                    texts = part["text"].cast(pa.large_binary())
                    best, p, gap = decode(model, np.stack([vector(texts[int(i)].as_py()) for i in at]))
                    score[at], unsure[at] = p, gap < margin
                    for i, j in zip(at, best, strict=True):
                        lang[i] = model.langs[j]
                cols = [part[k] for k in ("doc_id", *named)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", *named, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"{k} {v}" for k, v in d.dtypes if k not in ("_has", "text"))
    return d.mapInArrow(work, f"{kinds}, lang_pred string, score double, ambiguous boolean")
