"""Metrics of scores against binary truth, and threshold calibration.

Sweeps never scan the data per threshold: scores are counted once per distinct value, the counts are
cumulated from the top, and each threshold of the grid reads the cumulated counts below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions.patterns import STRONG
from textwarden.sources.writers import settled


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, 0 where undefined."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def with_metrics(counts: DataFrame) -> DataFrame:
    """tp, tn, fp, fn columns to accuracy, precision, recall, F1, F2, FPR, FNR, specificity, MCC."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    d = counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    spread = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return d.withColumns({
        "f1": ratio(2 * p * r, p + r), "f2": ratio(5 * p * r, 4 * p + r), "fnr": ratio(fn, tp + fn), "specificity": ratio(tn, tn + fp),
        "mcc": ratio((tp * tn - fp * fn).cast("double"), spread),
    })


def confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """One row of tp, tn, fp, fn."""
    y, z = F.col(label) == 1, predicted
    return df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in (("tp", y & z), ("tn", ~y & ~z), ("fp", ~y & z), ("fn", y & ~z))])


def two_sided(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    return sided(with_metrics(confusion(df, label, predicted)))


def sided(d: DataFrame) -> DataFrame:
    """Metrics of the safe class and the macro F1 beside those of the risky class."""
    sp, sr = ratio("tn", F.col("tn") + F.col("fn")), ratio("tn", F.col("tn") + F.col("fp"))
    d = d.withColumns({"safe_precision": sp, "safe_recall": sr})
    d = d.withColumn("safe_f1", ratio(2 * F.col("safe_precision") * F.col("safe_recall"), F.col("safe_precision") + F.col("safe_recall")))
    return d.withColumn("macro_f1", (F.col("f1") + F.col("safe_f1")) / 2)


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with running sums (new column: column summed) in order of a number, rows of equal numbers together.

    The rows are dealt to ranges of about equal numbers of rows, wherever they crowd (as many as the session has shuffle partitions), and written once; no
    task orders the whole table, and only the ranges' totals, a row each, meet in one.
    """
    ranges = max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    binned = settled(df.repartitionByRange(ranges, order).withColumn("_bin", F.spark_partition_id()))
    by = F.desc if descending else F.asc
    before = Window.orderBy(by("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy("_bin").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select("_bin", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_bin").orderBy(by(order))
    out = binned.join(F.broadcast(totals), "_bin").withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop("_bin", *[f"_b_{n}" for n in sums])


def histogram(df: DataFrame, label: str, score: str) -> DataFrame:
    """(p, pos, neg) per distinct score, and the counts at or above it; df is scanned once."""
    h = df.groupBy(F.col(score).alias("p")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    return running(h, "p", {"tp": "pos", "fp": "neg"}, descending=True)


def grid(spark: SparkSession, first: int, last: int, step: int, scale: int = 100) -> DataFrame:
    """Thresholds first / scale, ... in whole steps, so that they print alike everywhere."""
    return spark.range(first, last + 1, step).select((F.col("id") / scale).alias("threshold"))


def at_thresholds(df: DataFrame, thresholds: DataFrame, label: str, score: str) -> DataFrame:
    """tp, fp, tn, fn per threshold from one pass over df: every score finds its place in the (small) grid."""
    h = df.groupBy(F.col(score).alias("p")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    total = h.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    edges = thresholds.agg(F.sort_array(F.collect_list("threshold")).alias("ts"))
    place = h.join(F.broadcast(edges)).select("pos", "neg", F.expr("size(filter(ts, t -> t <= p))").alias("k"))
    counts = place.groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = thresholds.select("threshold", F.row_number().over(Window.orderBy("threshold")).alias("r"))
    met = ranked.join(F.broadcast(counts), F.col("k") >= F.col("r"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    return met.join(F.broadcast(total)).select("threshold", "tp", (F.col("n_neg") - F.col("fp")).alias("tn"), "fp", (F.col("n_pos") - F.col("tp")).alias("fn"))


def sweep(df: DataFrame, thresholds: DataFrame, label: str, score: str) -> DataFrame:
    return with_metrics(at_thresholds(df, thresholds, label, score))


def best_threshold(swept: DataFrame, max_fpr: float = 0.10, objective: str = "recall") -> DataFrame:
    """The row of best objective within the FPR cap, else the best of all. Ties: precision, F1, then the higher threshold."""
    order = [F.desc(F.col("fpr") <= max_fpr), F.desc(objective), F.desc("precision"), F.desc("f1"), F.desc("threshold")]
    return swept.orderBy(*order).limit(1)


def best_two_thresholds(df: DataFrame, spark: SparkSession, label: str, score: str, max_fpr_block: float = 0.05, max_fpr_warn: float = 0.15, min_recall_block: float = 0.85, min_recall_warn: float = 0.60) -> DataFrame:
    """The warn and block thresholds of best weighted score among the feasible ones of the 24 x 18 grid; no row if none is."""
    blocks = spark.range(24).select((0.35 + F.col("id") * (0.57 / 23)).alias("t_block"), F.col("id").alias("i"))
    pairs = blocks.select("t_block", "i", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("j")).withColumn("t_warn", 0.05 + F.col("j") * ((F.col("t_block") - 0.10) / 17))
    ts = pairs.select(F.col("t_block").alias("threshold")).union(pairs.select("t_warn")).distinct()
    c = at_thresholds(df, ts, label, score)
    b = c.select(F.col("threshold").alias("t_block"), *[F.col(k).alias(f"{k}_b") for k in ("tp", "fp", "tn", "fn")])
    a = c.select(F.col("threshold").alias("t_warn"), *[F.col(k).alias(f"{k}_a") for k in ("tp", "fp", "tn", "fn")])
    d = pairs.join(b, "t_block").join(a, "t_warn")
    d = d.withColumns({
        "block_recall": ratio("tp_b", F.col("tp_b") + F.col("fn_b")), "block_fpr": ratio("fp_b", F.col("fp_b") + F.col("tn_b")), "block_precision": ratio("tp_b", F.col("tp_b") + F.col("fp_b")),
        "combined_recall": ratio("tp_a", F.col("tp_a") + F.col("fn_a")), "combined_fpr": ratio("fp_a", F.col("fp_a") + F.col("tn_a")),
        "warn_tp": F.col("tp_a") - F.col("tp_b"), "warn_fp": F.col("fp_a") - F.col("fp_b"),
    }).withColumn("warn_precision", ratio("warn_tp", F.col("warn_tp") + F.col("warn_fp")))
    d = d.where((F.col("block_fpr") <= max_fpr_block) & (F.col("block_recall") >= min_recall_block) & (F.col("combined_fpr") <= max_fpr_warn) & (F.col("combined_recall") >= min_recall_warn))
    d = d.withColumn("score", 10 * F.col("block_recall") + 3 * F.col("combined_recall") + 2 * F.col("block_precision") + F.col("warn_precision") - 5 * F.col("block_fpr") - 2 * F.col("combined_fpr"))
    return d.orderBy(F.desc("score"), "i", "j").limit(1).select("t_warn", "t_block", "block_recall", "block_precision", "block_fpr", "warn_tp", "warn_fp", "warn_precision", "combined_recall", "combined_fpr", "score")


def best_three_class(df: DataFrame, spark: SparkSession, label: str, p_high: str, p_med: str, max_fpr: float = 0.10, min_high: float = 0.85, min_med: float = 0.35) -> DataFrame:
    """Best (high, med) thresholds of the 37 x 37 grid for three classes (label 0, 1, 2); scores are binned to the grid first, so one scan serves all pairs."""
    cell = lambda c: F.greatest(F.lit(-1), F.least(F.lit(36), F.floor((F.col(c) - 0.05) * 40 + 1e-9))).cast("int")
    h = df.groupBy(cell(p_high).alias("h"), cell(p_med).alias("m"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))  # at most 38 x 38 x 3 rows
    g = spark.range(37).select(F.col("id").cast("int").alias("a")).join(spark.range(37).select(F.col("id").cast("int").alias("b")))
    is_high, is_med = F.col("h") >= F.col("a"), (F.col("h") < F.col("a")) & (F.col("m") >= F.col("b"))
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    d = g.join(F.broadcast(h)).groupBy("a", "b").agg(
        part(is_high & (F.col("y") == 2)).alias("hh"), part(F.col("y") == 2).alias("nh"), part(is_med & (F.col("y") == 1)).alias("mm"), part(F.col("y") == 1).alias("nm"), part(is_high & (F.col("y") != 2)).alias("fh"), part(F.col("y") != 2).alias("nn"))
    d = d.select(((F.col("a") * 0.025) + 0.05).alias("t_high"), ((F.col("b") * 0.025) + 0.05).alias("t_med"), ratio("hh", "nh").alias("recall_high"), ratio("mm", "nm").alias("recall_med"), ratio("fh", "nn").alias("fpr"))
    ok = (F.col("fpr") <= max_fpr) & (F.col("recall_high") >= min_high) & (F.col("recall_med") >= min_med)
    return d.orderBy(F.desc(ok), F.desc("recall_high"), F.desc("recall_med"), "fpr", "t_high", "t_med").limit(1)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    h = histogram(df, label, score)
    n = h.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return h.join(F.broadcast(n)).select("p", "tp", "fp", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", "n_pos").alias("recall"), ratio("fp", "n_neg").alias("fpr"))


def areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ROC AUC and AUPRC by trapezes, and average precision, over the distinct scores. The point before is a row's sums without its own counts."""
    h = histogram(df, label, score)
    n = h.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    c = h.join(F.broadcast(n)).select(
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", "n_pos").alias("recall"), ratio("fp", "n_neg").alias("fpr"),
        F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(ratio(tp0, tp0 + fp0)).alias("prec0"), ratio(tp0, "n_pos").alias("rec0"), ratio(fp0, "n_neg").alias("fpr0"))
    return c.agg(
        F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("recall") + F.col("rec0")) / 2).alias("roc_auc"),
        F.sum((F.col("recall") - F.col("rec0")) * (F.col("precision") + F.col("prec0")) / 2).alias("auprc"),
        F.sum((F.col("recall") - F.col("rec0")) * F.col("precision")).alias("average_precision"))


def resample(curve: DataFrame, x: str, y: str, points: int = 101) -> DataFrame:
    """y at ``points`` even places of x in [0, 1], interpolated between neighbours.

    Of the curve only the first and last point of each of 4 (points - 1) even cells can be a place's neighbours; that table is small.
    """
    best = curve.groupBy(F.col(x).alias("x")).agg(F.max(y).alias("y"))
    cells = best.groupBy(F.floor(F.col("x") * (4 * (points - 1))).alias("cell")).agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"))
    best = cells.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("s")).select("s.x", "s.y")
    w = Window.orderBy("x")
    seg = best.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "first": F.row_number().over(w) == 1})
    g = curve.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("gx"))
    hit = g.join(F.broadcast(seg), (F.col("gx") >= F.col("x")) & ((F.col("gx") < F.col("x1")) | F.col("x1").isNull()) | F.col("first") & (F.col("gx") < F.col("x")), "left")
    t = F.when(F.col("x1").isNull() | (F.col("gx") < F.col("x")), F.col("y")).otherwise(F.col("y") + (F.col("y1") - F.col("y")) * (F.col("gx") - F.col("x")) / (F.col("x1") - F.col("x")))
    return hit.select(F.col("gx").alias(x), t.alias(y))


def downsample(curve: DataFrame, order: str, points: int = 96) -> DataFrame:
    """Up to ``points`` rows at rounded even places, first and last included; the rows differ in ``order``."""
    d = running(curve.withColumn("_one", F.lit(1)), order, {"_i": "_one"}).withColumn("_i", F.col("_i") - 1).join(F.broadcast(curve.agg(F.count(F.lit(1)).alias("_n"))))
    picks = F.expr(f"transform(sequence(0, {points - 1}), i -> cast(rint(i * (_n - 1) / {float(points - 1)}D) AS int))")
    return d.where((F.col("_n") <= points) | F.array_contains(picks, F.col("_i").cast("int"))).drop("_i", "_n", "_one")


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, from the counts of (truth, prediction)."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    each = c.select(F.explode(F.array_distinct(F.array("t", "z"))).alias("class"), "t", "z", "n")
    g = each.groupBy("class").agg(*[F.sum(F.when(k, F.col("n")).otherwise(0)).alias(a) for a, k in (("tp", (F.col("t") == F.col("class")) & (F.col("z") == F.col("class"))), ("fp", (F.col("t") != F.col("class")) & (F.col("z") == F.col("class"))), ("fn", (F.col("t") == F.col("class")) & (F.col("z") != F.col("class"))))])
    g = g.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_category(df: DataFrame, category: str, label: str, predicted: Column) -> DataFrame:
    """Precision, recall and F1 per category of the positives; the negatives count in every category."""
    cats = df.where(F.col(label) == 1).groupBy(F.col(category).alias("c")).agg(F.sum(F.when(predicted, 1).otherwise(0)).alias("tp"), F.sum(F.when(predicted, 0).otherwise(1)).alias("fn"))
    none = df.where(F.col(label) == 0).agg(F.coalesce(F.sum(F.when(predicted, 1).otherwise(0)), F.lit(0)).alias("fp"))
    d = cats.join(F.broadcast(none)).withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    return d.select(F.col("c").alias(category), "tp", "fp", "fn", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def safety_profile(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Misses and false alarms between low, med and high."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    t, z = F.col(truth), F.col(predicted)
    d = df.agg(n((t == "high") & (z == "low")).alias("high_to_low"), n((t == "high") & (z == "med")).alias("high_to_med"), n((t != "high") & (z == "high")).alias("other_to_high"), n(t == "high").alias("n_high"), n(t != "high").alias("n_other"))
    return d.withColumns({"miss_rate": ratio(F.col("high_to_low") + F.col("high_to_med"), "n_high"), "false_alarm_rate": ratio("other_to_high", "n_other")})


def candidate_hits(candidates: DataFrame, predictions: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """candidates with ``hit``: whether a predicted span (key, start, end) of the same text overlaps them (half-open)."""
    spans = predictions.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_spans"))
    hit = F.exists("_spans", lambda s: (F.col(end) > s["a"]) & (F.col(start) < s["b"]))
    return candidates.join(spans, F.col(key) == F.col("_key"), "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_key", "_spans")


def errors(df: DataFrame, truth: str, predicted: str, score: str) -> DataFrame:
    """The misclassified rows with ``missed_high``; missed high ones first, then by score from the top."""
    wrong = df.where(~F.col(truth).eqNullSafe(F.col(predicted))).withColumn("missed_high", F.col(truth) == "high")
    return wrong.orderBy(F.desc("missed_high"), F.desc(score))


def miss_patterns(df: DataFrame, text: str, start: str) -> DataFrame:
    """One row of counts over missed candidates: under three words, capitals only, numbers only, at the start of the text."""
    t = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    words = F.regexp_count(t, F.lit(r"\S+"))
    return df.agg(n(words < 3).alias("short"), n((F.upper(t) == t) & t.rlike("[A-Z]")).alias("capitals"), n(t.rlike("^[0-9./ -]+$")).alias("numbers_only"), n(F.col(start) == 0).alias("at_start"))


# Thresholds of the final check.
CHECKED = (0.35, 0.40, 0.45, 0.50)


def threshold_check(df: DataFrame, spark: SparkSession, label: str, score: str, thresholds: tuple[float, ...] = CHECKED) -> DataFrame:
    """Metrics of both classes at each threshold and ``place``: by macro F1, safe recall, risky precision, then the lower FPR."""
    c = at_thresholds(df, spark.createDataFrame([(t,) for t in thresholds], "threshold double"), label, score)
    d = sided(with_metrics(c))
    w = Window.orderBy(F.desc("macro_f1"), F.desc("safe_recall"), F.desc("precision"), "fpr", "threshold")  # a row per threshold
    return d.withColumn("place", F.row_number().over(w))


def class_limits(curve: DataFrame, least: float = 0.85) -> DataFrame:
    """One row of (warn, block) from a curve: the lowest score with that precision blocks, 0.15 below it (0.30 at least) warns; no row if none has."""
    t = curve.where(F.col("precision") >= least).agg(F.min("p").alias("t")).where("t IS NOT NULL")
    return t.select(F.round("t", 3).alias("block")).select(F.round(F.greatest(F.lit(0.30), F.col("block") - 0.15), 3).alias("warn"), "block")


def macro_auprc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the mean of the areas under the precision-recall curves of both classes (the safe class by 1 - score)."""
    safe = df.select((1 - F.col(label)).alias(label), (1 - F.col(score)).alias(score))
    return areas(df, label, score).select("auprc").union(areas(safe, label, score).select("auprc")).agg(F.avg("auprc").alias("macro_auprc"))


def best_and_last(log: DataFrame, order: str, metric: str, loss: str = "eval_loss", greater: bool = True) -> DataFrame:
    """(which, the columns of log): the evaluation row of best metric (of least loss where no row has the metric), and the last by ``order``."""
    e = log.where(F.col(loss).isNotNull())
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    m = F.col(metric) if greater else -F.col(metric)
    first = -F.col(order)  # of equal rows the first
    top = e.agg(F.max_by(row, F.when(F.col(metric).isNotNull(), F.struct(m.alias("m"), first.alias("o")))).alias("by_metric"), F.max_by(row, F.struct((-F.col(loss)).alias("m"), first.alias("o"))).alias("by_loss"), F.max_by(row, order).alias("last"))
    named = F.array(F.struct(F.lit("best").alias("which"), F.coalesce("by_metric", "by_loss").alias("r")), F.struct(F.lit("last").alias("which"), F.col("last").alias("r")))
    return top.where("last IS NOT NULL").select(F.explode(named).alias("x")).select("x.which", "x.r.*")


def mcnemar(df: DataFrame, label: str, a: Column, b: Column) -> DataFrame:
    ra, rb = a == (F.col(label) == 1), b == (F.col(label) == 1)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    d = df.agg(n(ra & rb).alias("both_right"), n(ra & ~rb).alias("only_a"), n(~ra & rb).alias("only_b"), n(~ra & ~rb).alias("both_wrong"))
    diff = F.abs(F.col("only_a") - F.col("only_b")).cast("double") - 1
    return d.withColumn("chi2", ratio(diff * diff, F.col("only_a") + F.col("only_b")))


# Limits of the release gate.
GATE = {"pass_rate": 0.92, "medium": 0.85, "risky": 0.98, "safe_fp": 0.03}


def gate(df: DataFrame, label: str, expected: str, action: str, limits: dict[str, float] = GATE) -> DataFrame:
    """One row of gate rates and the decision: promote, or a canary of 10 percent."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    ok, l, a = F.col(expected) == F.col(action), F.col(label), F.col(action)
    d = df.agg(F.count(F.lit(1)).alias("n"), n(ok).alias("n_pass"), n(l == "safe").alias("n_safe"), n((l == "safe") & (a != "silent")).alias("safe_hit"), n(l == "med").alias("n_med"), n((l == "med") & (a == "warn")).alias("med_hit"), n(l == "risky").alias("n_risky"), n((l == "risky") & (a == "block")).alias("risky_hit"))
    d = d.select("n", ratio("n_pass", "n").alias("pass_rate"), ratio("safe_hit", "n_safe").alias("safe_fp_rate"), ratio("med_hit", "n_med").alias("medium_warn_recall"), ratio("risky_hit", "n_risky").alias("risky_block_recall"))
    good = (F.col("pass_rate") >= limits["pass_rate"]) & (F.col("medium_warn_recall") >= limits["medium"]) & (F.col("risky_block_recall") >= limits["risky"]) & (F.col("safe_fp_rate") <= limits["safe_fp"])
    return d.withColumn("decision", F.when(good, "promote_to_full").otherwise("canary_10pct"))


def zones(df: DataFrame, label: str, score: str, warn: float, block: float) -> DataFrame:
    zone = F.when(F.col(score) >= block, "block").when(F.col(score) >= warn, "warn").otherwise("safe")
    return df.groupBy(zone.alias("zone"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def benign_profile(df: DataFrame, label: str, score: str, thresholds: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Of the rows with label 0: exact percentiles, maximum, mean and FPR at the thresholds."""
    p = F.expr(f"percentile({score}, array(0.5, 0.75, 0.9, 0.95, 0.99))")
    fpr = [F.avg(F.when(F.col(score) >= t, 1.0).otherwise(0.0)).alias(f"fpr_{int(t * 100)}") for t in thresholds]
    d = df.where(F.col(label) == 0).agg(p.alias("q"), F.max(score).alias("max"), F.avg(score).alias("mean"), *fpr)
    return d.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p75", "p90", "p95", "p99"))], "max", "mean", *[f"fpr_{int(t * 100)}" for t in thresholds])


def fused(prob: str, regex: Column, ner: Column, threshold: float) -> tuple[Column, Column]:
    """Decision and ranking score of rules, names and model together."""
    hit = regex | ner
    return hit | (F.col(prob) >= threshold), 0.7 * F.col(prob) + 0.3 * hit.cast("double")


def metric_pack(df: DataFrame, label: str, prob: str, regex: Column, ner: Column, calibrated: float, recommended: float) -> DataFrame:
    """Five rows: rules and names alone, and the model alone or with them at each of two limits; metrics, and the accuracy gained on the first. One scan."""
    hit, p = regex | ner, F.col(prob)
    configs = {"regex_ner": hit, "ml_val_calib": p >= calibrated, "ml_test_rec": p >= recommended, "full_val_calib": fused(prob, regex, ner, calibrated)[0], "full_test_rec": fused(prob, regex, ner, recommended)[0]}
    y = F.col(label) == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = [F.struct(F.lit(name).alias("config"), n(y & z).alias("tp"), n(~y & ~z).alias("tn"), n(~y & z).alias("fp"), n(y & ~z).alias("fn")).alias(name) for name, z in configs.items()]
    one = df.agg(*sums)
    base = ratio(F.col("regex_ner.tp") + F.col("regex_ner.tn"), F.col("regex_ner.tp") + F.col("regex_ner.tn") + F.col("regex_ner.fp") + F.col("regex_ner.fn"))
    rows = one.select(base.alias("_base"), F.explode(F.array(*configs)).alias("r")).select("_base", "r.*")
    return with_metrics(rows).withColumn("accuracy_gain", F.col("accuracy") - F.col("_base")).drop("_base")


def category_f1(rows: DataFrame, category: str, f1: str) -> DataFrame:
    """(category, f1) for the records: rows with an F1, without the report's totals, to three places."""
    return rows.where(F.col(f1).isNotNull() & ~F.col(category).isin("accuracy", "macro avg", "weighted avg")).select(F.col(category).alias("category"), F.round(f1, 3).alias("f1"))


def with_category_f1(records: dict, rows: DataFrame) -> dict:
    """The records with metrics.per_category replaced by the rows of :func:`category_f1`, a few for each class."""
    found = {r["category"]: {"f1": r["f1"]} for r in rows.collect()}
    return records | {"metrics": (records.get("metrics") or {}) | {"per_category": found}}


def configuration_curves(df: DataFrame, label: str, prob: str, regex: Column, ner: Column, thresholds: tuple[float, ...] = tuple(i / 20 for i in range(1, 20))) -> DataFrame:
    """config, threshold, the metrics at it, and the accuracy gained on rules and names alone: for rules and names, the model, and all together.

    One scan: each row gives a bin of thresholds for every configuration, grouping sets count the labels of all bins in one partial aggregate
    (at most a row for each bin), and running sums over a configuration's bins give its curve.
    """
    hit = regex | ner
    scores = {"regex_ner": hit.cast("double"), "ml": F.col(prob), "full": fused(prob, regex, ner, 1.0)[1]}
    reached = lambda s: sum((F.when(s >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    binned = df.select((F.col(label) == 1).cast("long").alias("_y"), *[reached(s).alias(f"_{c}") for c, s in scores.items()])
    sets = [[F.col(f"_{c}")] for c in scores]
    counts = binned.groupingSets(sets, *[F.col(f"_{c}") for c in scores]).agg(F.grouping_id().alias("_set"), F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    # in a grouping set's number the bits of the columns left out are 1
    named = F.create_map(*[F.lit(x) for i, c in enumerate(scores) for x in ((1 << len(scores)) - 1 - (1 << len(scores) - 1 - i), c)])
    bins = counts.select(named[F.col("_set").cast("int")].alias("config"), F.coalesce(*[f"_{c}" for c in scores]).alias("bin"), "pos", "neg")
    every = bins.groupBy("config").agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"))  # a few rows, each of a bin for each threshold at most
    upto = lambda c, above: F.aggregate(F.filter("bins", lambda b: (b["bin"] >= F.col("i")) == F.lit(above)), F.lit(0).cast("long"), lambda s, b: s + b[c])
    at = every.select("config", "bins", F.posexplode(F.array(*map(F.lit, thresholds))).alias("i", "threshold")).withColumn("i", F.col("i") + 1)
    rows = with_metrics(at.select("config", "threshold", upto("pos", True).alias("tp"), upto("neg", False).alias("tn"), upto("neg", True).alias("fp"), upto("pos", False).alias("fn")))
    base = F.max(F.when(F.col("config") == "regex_ner", F.col("accuracy"))).over(Window.partitionBy("threshold"))
    return rows.withColumn("accuracy_gain", F.col("accuracy") - base)


def importance_probe(df: DataFrame, key: str, text_col: str, prob: str, thresholds: tuple[float, ...] = (0.10, 0.45, 0.65)) -> DataFrame:
    """Per row: the matches of the strong detectors, their names, and the model's own decision at each threshold, so that what only the model sees can be told."""
    counts = {p: F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(p.test)) for p in STRONG}
    names = list(dict.fromkeys(p.name for p in STRONG))
    seen = [F.when(sum((n for p, n in counts.items() if p.name == name), F.lit(0)) > 0, F.lit(name)) for name in names]
    decided = [F.when(F.col(prob) >= t, "risky").otherwise("safe").alias(f"tau_{int(100 * t):02d}") for t in thresholds]
    return df.select(key, sum(counts.values(), F.lit(0)).cast("long").alias("regex_matches"), F.filter(F.array(*seen), lambda x: x.isNotNull()).alias("regex_types"), F.col(prob), *decided)


def probe_summary(probed: DataFrame, thresholds: tuple[float, ...] = (0.10, 0.45, 0.65)) -> DataFrame:
    """(threshold, both, rules_only, model_only, neither): a row for each threshold."""
    hit = F.col("regex_matches") > 0
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    risky = {t: F.col(f"tau_{int(100 * t):02d}") == "risky" for t in thresholds}
    one = probed.agg(*[F.struct(F.lit(t).alias("threshold"), n(hit & z).alias("both"), n(hit & ~z).alias("rules_only"), n(~hit & z).alias("model_only"), n(~hit & ~z).alias("neither")).alias(f"t{i}") for i, (t, z) in enumerate(risky.items())])
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")
