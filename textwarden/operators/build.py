"""Putting a training set together from real and made-up rows, and the fixed-size form that a model takes.

Rows have key (unique), text, risk and source. What the driver holds are counts of classes; all else are plans over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.batches import pieces
from textwarden.operators import curate
from textwarden.sources import generators
from textwarden.sources.writers import settled

# Least rows of each class in the hold-out and in the splits; the largest class of an evaluation split against its smallest floor.
HOLDOUT_LEAST = {"low": 20, "med": 20, "high": 20}
TRAIN_LEAST = {"low": 600, "med": 1400, "high": 400}
VAL_LEAST = {"low": 30, "med": 60, "high": 30}
TEST_LEAST = {"low": 40, "med": 120, "high": 40}
MOST_RATIO = 3.0
ROW = ("key", "text", "risk", "source")


def made(spark: SparkSession, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """Made-up rows with keys."""
    return generators.mixture(spark, counts, seed).selectExpr("concat(source, '-', id) AS key", "text", "risk", "source")


def class_counts(df: DataFrame, label: str = "risk") -> dict[str, int]:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def topped_up(df: DataFrame, least: dict[str, int], seed: int) -> DataFrame:
    """df with made-up rows of the classes that are below their least count."""
    have = class_counts(df)
    lacking = {generators.TOP_UP[c]: n - have.get(c, 0) for c, n in least.items() if have.get(c, 0) < n}
    return df.unionByName(made(df.sparkSession, lacking, seed)) if lacking else df


def covered(df: DataFrame, least: dict[str, int], most_ratio: float | None, seed: int) -> DataFrame:
    """Classes up to most_ratio times the smallest floor (all rows with None), then topped up."""
    if most_ratio is not None:
        df = curate.cap_per_class(df, "key", "risk", {c: int(most_ratio * min(least.values())) for c in least}, seed)
    return topped_up(df, least, seed)


def binary_risk(risk: str) -> str:
    return f"CASE WHEN {risk} IN ('low', 'safe') THEN 'safe' ELSE 'risky' END"


def training_splits(
    spark: SparkSession, real: DataFrame, holdout: tuple[str, ...] = (), wanted: int = 1000, times: int = 2, binary: bool = False, adversarial: int = 800,
    safe_target: int = 5000, most: int = 5000, val_share: float = 0.15, seed: int = curate.SEED,
) -> DataFrame:
    """(key, text, risk, source, split) from real labelled rows.

    1. Made-up finance rows join them: ``wanted``, but no more than ``times`` the real ones.
    2. Rows of the sources ``holdout`` are the test split, with real rows moved there until it has HOLDOUT_LEAST of each class.
    3. Binary: low is safe, the rest risky; adversarial rows join, and safe business rows up to min(safe_target, the larger class).
    4. Equal texts once (real before made-up), a stratified split; a small pool is train as a whole.
    5. Binary: train at two equal halves of up to ``most``. Otherwise each split with its floors, by made-up rows of a seed of its own,
       so no two splits get the same.
    Rows that binary halves repeat are repeated here.
    """
    real = real.select(*ROW)
    n = real.count()
    pool, held = real, None
    if holdout:
        named = F.coalesce(F.lower(F.trim("source")).isin(*holdout), F.lit(False))
        held, pool = map(settled, curate.holdout_coverage(real.where(named), real.where(~named), "key", "risk", HOLDOUT_LEAST, seed))
    pool = pool.withColumn("rank", F.lit(0)).unionByName(made(spark, generators.finance_counts(min(wanted, times * n) if n else wanted)).withColumn("rank", F.lit(1)))
    if binary:
        to_binary = lambda d: d.withColumn("risk", F.expr(binary_risk("risk")))
        pool = to_binary(pool.unionByName(made(spark, {"adversarial": adversarial}).withColumn("rank", F.lit(2))))
        held = to_binary(held) if held is not None else None
        have = class_counts(pool)
        gap = min(safe_target, max(have.values(), default=0)) - have.get("safe", 0)
        if gap > 0:
            pool = pool.unionByName(to_binary(made(spark, {"safe_business": gap}).withColumn("rank", F.lit(3))))
    pool = settled(curate.exact_dedupe(pool, "rank", "key").select(*ROW))
    tested = held is not None and not held.isEmpty()
    shares = (1 - val_share, val_share, 0.0) if tested else (0.70, 0.15, 0.15)
    out = settled(curate.small_corpus_guard(curate.stratified_split(pool, "key", "risk", shares, seed), "split", "risk"))
    parts = {s: out.where(F.col("split") == s).select(*ROW) for s in ("train", "validation", "test")}
    if tested:
        parts["test"] = parts["test"].unionByName(held.select(*ROW))
    if binary:
        parts["train"] = curate.binary_halves(parts["train"], "key", "risk", most, seed).select(*ROW)
    else:
        parts = {
            "train": covered(parts["train"], TRAIN_LEAST, None, 55), "validation": covered(parts["validation"], VAL_LEAST, MOST_RATIO, 77),
            "test": covered(parts["test"], TEST_LEAST, MOST_RATIO, 99),
        }
    a, b, c = (d.withColumn("split", F.lit(s)) for s, d in parts.items())
    return a.unionByName(b).unionByName(c)


def manifest(splits: DataFrame) -> DataFrame:
    """Rows per split, source and class."""
    return splits.groupBy("split", "source", "risk").agg(F.count(F.lit(1)).alias("n"))


# Rows of each class of the blind set, and of the set of safe rows.
BLIND_EACH, SAFE_TOTAL, BLIND_POOL = 40, 80, 400


def blind_sets(spark: SparkSession, known: DataFrame, each: int = BLIND_EACH, safe: int = SAFE_TOTAL, pool: int = BLIND_POOL, seed: int = 7, threshold: float = 0.62) -> DataFrame:
    """(set, label, text): made-up rows, none near a known text: ``each`` safe, medium and risky ones, and ``safe`` safe ones for a set of their own."""
    def fresh(kind: str, n: int) -> DataFrame:
        return curate.candidates(generators.rows(spark, kind, pool, seed).select("text"), known, "text", n, threshold)

    parts = (("blind", "safe", "low", each), ("blind", "medium", "hard_med", each), ("blind", "risky", "hard_high", each), ("safe", "safe", "low", safe))
    out = None
    for name, label, kind, n in parts:
        d = fresh(kind, n).select(F.lit(name).alias("set"), F.lit(label).alias("label"), "text")
        out = d if out is None else out.unionByName(d)
    return out


Encoder = Callable[[list[str]], list[list[int]]]


def tokenise(df: DataFrame, load: Callable[[], Encoder], text_col: str = "text", length: int = 128, pad: int = 0) -> DataFrame:
    """df with input_ids and attention_mask of a fixed length: cut or padded. ``load`` makes the encoder once in each task."""
    df = df.drop("input_ids", "attention_mask")
    names = df.columns
    kind = pa.list_(pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in pieces(batches, text_col):
            found = [ids[:length] for ids in encode([t or "" for t in batch.column(names.index(text_col)).to_pylist()])]
            ids = [x + [pad] * (length - len(x)) for x in found]
            mask = [[1] * len(x) + [0] * (length - len(x)) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, kind), pa.array(mask, kind)], [*names, "input_ids", "attention_mask"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)
    return df.mapInArrow(work, f"{kinds}, input_ids array<int>, attention_mask array<int>")
