"""Building training tables: sources, deduplication, leakage checks, splits and class balance.

Sampling orders rows by the MD5 of seed and id instead of a random generator, so results
don't depend on partitions. First-wins choices are minima in partial aggregates, not windows
over a key that may be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions import text as X
from textwarden.functions.dialect import SPARK
from textwarden.operators.near import near_rows
from textwarden.sources.writers import settled

SEED = 42


def draw(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def union_sources(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows with source and source_rank; the order of the sources decides which duplicate stays."""
    parts = [df.withColumn("source", F.lit(n)).withColumn("source_rank", F.lit(i)) for i, (n, df) in enumerate(named)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_of(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row, by the order, of each key; rows with a null key stay."""
    cols = [f"`{c}`" for c in df.columns]
    keyed = df.withColumn("_k", key)
    best = keyed.where("_k IS NOT NULL").groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("row"))
    return best.select("row.*").unionByName(keyed.where("_k IS NULL").drop("_k"))


def fingerprint_dedupe(df: DataFrame, *order: str, text_col: str = "text", least: int = 20, most: int = 1000) -> DataFrame:
    """Texts of usable length, one for each leakage fingerprint."""
    usable = df.where(F.length(text_col).between(least, most))
    return first_of(usable, F.expr(X.fingerprint(SPARK, text_col)), *order)


def exact_dedupe(df: DataFrame, *order: str, text_col: str = "text") -> DataFrame:
    return first_of(df, F.md5(text_col), *order)


def near_duplicates(df: DataFrame, corpus: DataFrame, id_col: str, corpus_id: str, text_col: str = "text", threshold: float = 0.62) -> DataFrame:
    """(id, corpus id, jaccard) at or above the threshold, exact.

    Pairs of different sets that may match are found from hashed tokens in bounded cells (:func:`near.near_rows`) and compared by their strings,
    each set moved once for each of its cells and not for each pair; ids join last. Rows are told apart by a number of their own, so repeated and null ids are rows
    like any other.
    """
    def tokens(d: DataFrame, k: str) -> DataFrame:
        sets = d.select(F.col(k).alias("id"), F.expr(X.token_set(SPARK, text_col)).alias("set")).where(F.size("set") > 0)
        key = F.unhex(F.md5(F.array_join(F.sort_array("set"), " ")))
        return settled(sets.withColumns({"row": F.monotonically_increasing_id(), "key": key}))  # read several times below

    a, b = tokens(df, id_col), tokens(corpus, corpus_id)
    pairs = settled(near_rows(a, b, threshold))  # its size is known, so if it is small the sets stay where they are
    ours = pairs.groupBy("cell", "row").agg(F.collect_list("other").alias("others")).join(a.select("row", "set", F.col("key").alias("key_a")), "row")
    theirs = pairs.select("cell", "other").distinct().join(b.select(F.col("row").alias("other"), F.col("set").alias("set_o"), F.col("key").alias("key_b")), "other")
    j = F.size(F.array_intersect("set", "set_o")) / F.size(F.array_union("set", "set_o"))
    met = F.when(F.array_contains("others", F.col("other")), j)  # a cell's other combinations are not compared
    both = ours.join(theirs.withColumnRenamed("cell", "cell_o"), (F.col("cell") == F.col("cell_o")) & (met >= threshold))
    alike = both.select("key_a", "key_b", j.alias("jaccard"))
    ids = alike.join(a.select(F.col("key").alias("key_a"), F.col("id").alias("id_a")), "key_a").join(b.select(F.col("key").alias("key_b"), F.col("id").alias("id_b")), "key_b")
    return ids.select(F.col("id_a").alias(id_col), F.col("id_b").alias(corpus_id), "jaccard")


def placed(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """df with ``_at``: each row's place (from 1) in its class by digest, and ``_n``: the rows of the class.

    Places come from counts per (class, digest prefix) plus the order within the prefix, so no window holds a whole class. A
    null label is a class of its own.
    """
    keyed = df.withColumn("_h", draw(key, seed)).withColumn("_p", F.substring("_h", 1, 4)).withColumn("_c", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))  # never null, so rows stay where the window put them
    bins = keyed.groupBy("_c", "_p").agg(F.count(F.lit(1)).alias("_k"))  # at most 65536 rows for each class
    w = Window.partitionBy("_c").orderBy("_p")
    before = bins.select(F.col("_c").alias("_c2"), F.col("_p").alias("_p2"), (F.sum("_k").over(w) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy("_c")).alias("_n"))
    inner = F.row_number().over(Window.partitionBy("_c", "_p").orderBy("_h", key))
    at = keyed.withColumn("_r", inner).join(before, (F.col("_c") == F.col("_c2")) & (F.col("_p") == F.col("_p2")))
    return at.withColumn("_at", F.col("_before") + F.col("_r")).drop("_h", "_p", "_c", "_c2", "_p2", "_before", "_r")


def stratified_split(df: DataFrame, key: str, label: str, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = SEED) -> DataFrame:
    """df with ``split``. If some class has one row only, the split ignores classes.

    No window holds a whole class (:func:`placed`).
    """
    small = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_least"))
    keyed = df.join(F.broadcast(small)).withColumn("_class", F.when(F.col("_least") >= 2, F.coalesce(F.col(label).cast("string"), F.lit(""))).otherwise("")).drop("_least")
    at = placed(keyed, key, "_class", seed)
    train, val = shares[0], shares[0] + shares[1]
    split = F.when(F.col("_at") <= F.round(F.col("_n") * train), "train").when(F.col("_at") <= F.round(F.col("_n") * val), "validation").otherwise("test")
    return at.withColumn("split", split).select(*[F.col(f"`{c}`") for c in df.columns], "split")


def overlap_matrix(df: DataFrame, split: str = "split", text_col: str = "text", pairs=(("train", "validation"), ("train", "test"), ("validation", "test"))) -> DataFrame:
    """For each pair of splits: distinct normalised texts in both, and their shares of each."""
    seen = df.select(F.expr(X.audit_key(SPARK, text_col)).alias("h"), split).groupBy("h").agg(F.collect_set(split).alias("s"))
    sums = [F.sum(F.expr(f"cast(array_contains(s, '{a}') AS int)")).alias(f"n_{a}") for a in dict.fromkeys(x for p in pairs for x in p)]
    both = [F.sum(F.expr(f"cast(array_contains(s, '{a}') AND array_contains(s, '{b}') AS int)")).alias(f"b_{a}_{b}") for a, b in pairs]
    one = seen.agg(*sums, *both)
    rows = ", ".join(f"named_struct('left_split', '{a}', 'right_split', '{b}', 'n_both', b_{a}_{b}, 'share_left', b_{a}_{b} / n_{a}, 'share_right', b_{a}_{b} / n_{b})" for a, b in pairs)
    return one.select(F.explode(F.expr(f"array({rows})")).alias("r")).select("r.*")


def leakage(train: DataFrame, val: DataFrame, text_col: str = "text", warn: float = 0.05) -> DataFrame:
    """One row: validation rows whose text is in train, their share, and whether it is too large."""
    keys = train.select(F.md5(text_col).alias("h")).distinct()
    hit = val.select(F.md5(text_col).alias("h")).join(keys.withColumn("in_train", F.lit(1)), "h", "left")
    return hit.agg(F.sum(F.coalesce("in_train", F.lit(0))).cast("long").alias("leaked"), F.count(F.lit(1)).alias("rows")).select("leaked", "rows", (F.col("leaked") / F.col("rows")).alias("share")).withColumn("too_large", F.col("share") > warn)


def cap_per_class(df: DataFrame, key: str, label: str, caps: dict[str, int], seed: int = SEED) -> DataFrame:
    """Up to the cap of each class, by digest; classes without a cap go."""
    capped = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    d = df.withColumn("_cap", capped[F.col(label).cast("string")]).where("_cap IS NOT NULL")
    return placed(d, key, label, seed).where("_at <= _cap").select(*[F.col(f"`{c}`") for c in df.columns])


def oversample(df: DataFrame, key: str, label: str, target: str = "max", seed: int = SEED) -> DataFrame:
    """Each class brought to the target count (max, min or median of the classes) by copies or by dropping, with ``copy`` from 0."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    want = {"max": F.max("_n"), "min": F.min("_n"), "median": F.expr("percentile(_n, 0.5)")}[target]
    d = placed(df.where(F.col(label).isNotNull()), key, label, seed).join(F.broadcast(n.where(F.col(label).isNotNull()).agg(want.cast("long").alias("_t"))))
    return _copied(d, df.columns)


def _copied(d: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a place ``_at`` in a class of ``_n`` as often as it takes to get ``_t`` rows of the class; adds ``copy`` from 0."""
    copies = F.expr("cast(floor((_t - _at) / _n) AS int)")
    return d.where("_at <= _t").select(*[F.col(f"`{c}`") for c in columns if c != "copy"], F.explode(F.sequence(F.lit(0), copies)).alias("copy"))


def class_weights(df: DataFrame, label: str, mean_one: bool = True, root: bool = False) -> DataFrame:
    """total / (classes * count), scaled to a mean of 1 or a sum of the number of classes."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    raw = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    w = n.withColumn("raw", F.sqrt(raw) if root else raw)
    scale = F.avg("raw").over(every) if mean_one else F.sum("raw").over(every) / F.count(F.lit(1)).over(every)
    return w.select(label, "n", (F.col("raw") / scale).alias("weight"))


def source_report(df: DataFrame, source: str = "source", label: str | None = None, text_col: str = "text") -> DataFrame:
    labelled = F.count(label) if label else F.lit(0)
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"), labelled.cast("long").alias("n_labelled"), F.avg(F.length(text_col)).alias("mean_chars"))


def audit(df: DataFrame, text_col: str = "text") -> DataFrame:
    keys = df.select(F.expr(X.audit_key(SPARK, text_col)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def class_floors(df: DataFrame, key: str, label: str, floors: dict[str, int], most: float | None = None, seed: int = SEED) -> DataFrame:
    """Classes below their floor are raised to it by copies; with ``most``, none keeps more than that times the smallest floor. Adds ``copy``."""
    table = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))])
    cap = F.lit(int(most * min(floors.values()))) if most else F.col("_n")
    d = placed(df.where(F.col(label).isNotNull()), key, label, seed)
    target = F.greatest(F.coalesce(table[F.col(label).cast("string")], F.lit(0)), F.least(F.col("_n"), cap))
    return _copied(d.withColumn("_t", target.cast("long")), df.columns)


def holdout_coverage(holdout: DataFrame, pool: DataFrame, key: str, label: str, least: dict[str, int], seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(hold-out, pool): real rows moved from the pool until each class of the hold-out has its least count, as far as the pool goes."""
    have = holdout.groupBy(label).agg(F.count(F.lit(1)).alias("_have"))
    table = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])
    ranked = placed(pool, key, label, seed).join(F.broadcast(have), label, "left")  # a row for each class
    moved = ranked.where(F.col("_at") <= F.coalesce(table[F.col(label).cast("string")], F.lit(0)) - F.coalesce("_have", F.lit(0))).select(*[F.col(f"`{c}`") for c in pool.columns])
    return holdout.unionByName(moved), pool.join(F.broadcast(moved.select(key)), key, "left_anti")  # no more rows than the least counts


def binary_halves(df: DataFrame, key: str, label: str, most: int = 5000, seed: int = SEED) -> DataFrame:
    """Both classes at min(largest class, most) rows, by sampling or copies."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    target = n.agg(F.least(F.max("n"), F.lit(most)).alias("t")).first()[0] or 0
    kinds = [r[0] for r in n.select(F.col(label).cast("string")).collect()]
    return cap_copies(df, key, label, {k: target for k in kinds}, seed)


def cap_copies(df: DataFrame, key: str, label: str, targets: dict[str, int], seed: int = SEED) -> DataFrame:
    """Each class at its target, by sampling or copies; adds ``copy``."""
    return class_floors(cap_per_class(df, key, label, targets, seed), key, label, targets, seed=seed)


def labelled_rows(df: DataFrame, label: str = "risk") -> DataFrame:
    """Rows with a label that isn't blank."""
    return df.where(F.trim(F.coalesce(F.col(label), F.lit(""))) != "")


def manual_overlap(manual: DataFrame, train: DataFrame, val: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: how many different texts (trimmed, lower case) of the manual set are also in train, and in validation."""
    key = F.expr(f"lower({SPARK.strip(text_col)})")
    sets = [d.select(F.md5(key).alias("h"), F.lit(n).alias("n")) for n, d in (("m", manual), ("t", train), ("v", val))]
    seen = reduce(lambda a, b: a.unionByName(b), sets).where("h IS NOT NULL").groupBy("h").agg(*[F.max(F.col("n") == x).alias(x) for x in "mtv"])
    hit = lambda c: F.coalesce(F.sum(F.expr(f"cast(m AND {c} AS int)")), F.lit(0)).cast("long")
    return seen.agg(hit("t").alias("in_train"), hit("v").alias("in_validation"))


def span_splits(train: DataFrame, test: DataFrame, key: str, most_train: int = 20_000, most_val: int = 3_000, most_test: int = 5_000, share: float = 0.15, seed: int = SEED) -> DataFrame:
    """Rows (with ``risk``) of a span corpus in three splits: a stratified share of the train rows is validation; each split is capped by digest."""
    d = train.orderBy(draw(key, seed), key).limit(most_train)
    d = stratified_split(d, key, "risk", (1 - share, 0.0, share), seed).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("validation"))
    val = d.where("split = 'validation'").orderBy(draw(key, seed + 1), key).limit(most_val)
    held = test.orderBy(draw(key, seed), key).limit(most_test).withColumn("split", F.lit("test"))
    return d.where("split = 'train'").unionByName(val).unionByName(held)


def equal_thirds(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """low, med and high at the count of med (of the smallest class, if there is no med)."""
    n = {r[0]: r[1] for r in df.where(F.col(label).isin("low", "med", "high")).groupBy(label).count().collect()}
    t = n.get("med") or min(n.values(), default=0)
    return cap_copies(df, key, label, {k: t for k in n}, seed)


def small_corpus_guard(df: DataFrame, split: str, label: str, least: int = 20, per_class: int = 2) -> DataFrame:
    """With fewer than ``least`` rows, or a class below ``per_class``, everything is train."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg((F.sum("c") < least).alias("a"), (F.min("c") < per_class).alias("b"))
    return df.join(F.broadcast(n)).withColumn(split, F.when(F.col("a") | F.col("b"), "train").otherwise(F.col(split))).drop("a", "b")


def candidates(texts: DataFrame, known: DataFrame, text_col: str, n: int, threshold: float = 0.62) -> DataFrame:
    """The first n different texts that aren't near any known text."""
    d = texts.select(F.expr(X.words_key(SPARK, text_col)).alias("_k"), text_col).where("_k <> ''").groupBy("_k").agg(F.min(text_col).alias(text_col))
    one = known.select(F.md5(text_col).alias("_o"), F.col(text_col)).where("_o IS NOT NULL").dropDuplicates(["_o"])
    near = near_duplicates(d, one, "_k", "_o", text_col, threshold).select("_k").distinct()
    return d.join(near, "_k", "left_anti").orderBy("_k").limit(n).select(text_col)
