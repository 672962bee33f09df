"""Mixing sources to target weights, with DataFrame functions only.

Word counts are aggregated per source (partial sums first, so a source that holds a third of all
rows costs one row per task). Sources take weights in turn; their targets are the weighted
shares of the total, stopped at ``cap`` times the source, the excess reshared by weight: the
water level is found from running sums over the sources in order of cap over weight. The rate of
a source is target / size; each document comes floor(rate) times and once more if a
uniform number, hashed from seed and id, is below the fraction.

Results for odd input: null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0; a null id draws by its text's digest; repeated
rows share their draw; columns beside id, text and source are kept by :func:`emit` and
ignored by :func:`plan`, whatever their names; sources of equal cap over weight take their order by name; a very long text is
counted whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.storage import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
#: Rows of the table of sources that may be sent to every task.
BROADCAST_SOURCES = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "source").withColumn("size", _size())


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: one row per source."""
    w = "CASE " + " ".join(f"WHEN (rank - 1) % {len(weights)} = {i} THEN {float(x)}D" for i, x in enumerate(weights)) + " END"
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return (
        by_source.selectExpr("*", "row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank", f"{share}D * sum(source_size) OVER () AS goal")
        .selectExpr("*", f"{w} AS weight", f"{cap}D * source_size AS most")
        .selectExpr(
            "*",
            "coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS most_before",
            "sum(weight) OVER (ORDER BY most / weight DESC, rank DESC) AS weight_from",
        )
        .selectExpr("*", "(goal - most_before) / weight_from >= most / weight AS full")
        .selectExpr("*", "sum(CASE WHEN full THEN most ELSE 0D END) OVER () AS taken_full", "sum(CASE WHEN full THEN 0D ELSE weight END) OVER () AS weight_left")
        .selectExpr("source", "source_size", "CASE WHEN full THEN most ELSE weight * (goal - taken_full) / weight_left END AS target")
    )


def _joined(sized: DataFrame, shares: dict) -> DataFrame:
    """sized (with size, draw) beside its source's source_size and target, and copies.

    The table of sources, a row each, is written once; up to BROADCAST_SOURCES rows it is sent to the tasks, beyond
    that both sides are dealt by source and hot sources split by the adaptive join.
    """
    per = checkpointed(targets(sized.select("source", "size"), **shares).withColumnRenamed("source", "its_source"))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    return (
        sized.join(per, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
        .withColumn("rate", F.expr("CASE WHEN source_size = 0 THEN 0D ELSE target / source_size END"))
        .withColumn("copies", F.expr("cast(floor(rate) AS int) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END"))
    )


def _draw(seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the digest of seed and id."""
    return F.expr(f"cast(conv(substring(md5(concat('{seed}|', coalesce(cast(doc_id AS string), md5(text), ''))), 1, 13), 16, 10) AS double) / 4503599627370496D")


def plan(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document. Texts aren't moved."""
    sized = sizes(docs).withColumn("draw", _draw(seed)).drop("text")
    return _joined(sized, shares).selectExpr("doc_id", "source", "size", "source_size", "target", "size * copies AS taken", "copies")


def emit(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The mix itself: each document as often as planned, with its columns and ``copy`` from 1 (which replaces a column of that name)."""
    docs = docs.drop("copy")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    sized = docs.select(whole).select("whole", F.col("whole.source").alias("source"), F.col("whole.doc_id").alias("doc_id"), F.col("whole.text").alias("text"))
    sized = sized.withColumn("size", _size()).withColumn("draw", _draw(seed)).drop("text", "doc_id")
    return _joined(sized, shares).where("copies > 0").select("whole", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("whole.*", "copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight, 2::DOUBLE * source_size AS most FROM r),
b AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS most_before,
      sum(weight) OVER (ORDER BY most / weight DESC, rank DESC) AS weight_from FROM w),
f AS (SELECT *, (goal - most_before) / weight_from >= most / weight AS is_full FROM b),
l AS (SELECT *, sum(CASE WHEN is_full THEN most ELSE 0::DOUBLE END) OVER () AS taken_full, sum(CASE WHEN is_full THEN 0::DOUBLE ELSE weight END) OVER () AS weight_left FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * (goal - taken_full) / weight_left END AS target FROM l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0::DOUBLE ELSE t.target / t.source_size END AS rate,
      ('0x' || substr(md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), md5(d.text), '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
