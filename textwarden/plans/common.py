"""What the query modules share: table readers and the stand-in score of labelled documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]
    sql: str | None = None


#: Bytes of a file for each core up to which it is dealt out before costly work: such a file may be a single row group.
SMALL = 32 << 20


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores if its files are small, as it is if they are large: a file of a single row group is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def scored_labels(t: Callable[[str], DataFrame]) -> DataFrame:
    """doc_id, y (toxic), p: a reproducible score that goes with the label, where no model is at hand."""
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return t("labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("y"), F.round(draw * 0.5 + F.col("toxic") * 0.4, 3).alias("p"))


SCORED = "SELECT doc_id, toxic AS y, round(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE * 0.5::DOUBLE + toxic * 0.4::DOUBLE, 3) AS p FROM labels WHERE toxic IS NOT NULL"


def events(t: Callable[[str], DataFrame]) -> DataFrame:
    """The event table as guardrail events: score from value, class from event_type."""
    from textwarden.operators import events as E

    return E.normalise(t("events"), F.col("ts"), F.floor("value"), classes=F.col("event_type"))


EVENTS = "SELECT *, CASE WHEN risk_score >= 80 THEN 'block' WHEN risk_score > 30 THEN 'warn' ELSE 'silent' END AS action FROM (SELECT *, greatest(0, least(100, coalesce(floor(value), 0)))::INTEGER AS risk_score FROM events)"
