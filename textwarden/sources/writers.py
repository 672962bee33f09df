"""Sinks: event logs, exports, splits and metric bundles."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import text as X
from textwarden.functions.dialect import SPARK


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode one is made if none is named."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="settled-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to a new folder in the shared one and read again, for plans that read it several times."""
    path = f"{shared(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_events(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Scoring events: the text's hash instead of the text, the rest of the row as JSON context."""
    rest = [c for c in df.columns if c not in (text_col, "pii_class", "confidence", "action")]
    out = df.select(F.expr(X.text_hash(SPARK, text_col)).alias("text_hash"), "pii_class", "confidence", "action", F.to_json(F.struct(*rest)).alias("context_json"), F.current_timestamp().alias("created_at"))
    out.write.mode("append").parquet(path)


def scan_history(df: DataFrame, path: str) -> None:
    """One row for each scanned document."""
    df.withColumn("scanned_at", F.current_timestamp()).write.mode("append").parquet(path)


def with_reports(history: DataFrame, reports: DataFrame, key: str = "scan_id") -> DataFrame:
    """The history with the report paths of ``reports`` (key, report_path); other rows keep theirs."""
    own = F.col("report_path") if "report_path" in history.columns else F.lit(None).cast("string")
    d = history.withColumn("_own", own).drop("report_path").join(reports.select(key, F.col("report_path").alias("_new")).dropDuplicates([key]), key, "left")
    return d.withColumn("report_path", F.coalesce("_new", "_own")).drop("_own", "_new")


def report_html(findings: DataFrame, title: str, most: int = 1000, longest: int = 80) -> str:
    """A page that lists the first ``most`` findings (class, match, risk); of a longer match only that the section is sensitive."""
    import html

    rows = findings.select("class", "match", "risk").orderBy("class", "match").limit(most).collect()
    shown = lambda m: html.escape(m) if len(m) <= longest else "section with sensitive text"
    lines = "".join(f"<tr><td>{html.escape(r[0])}</td><td>{shown(r[1] or '')}</td><td>{html.escape(r[2] or '')}</td></tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr><th>Class</th><th>Match</th><th>Risk</th></tr>{lines}</table>"


def export_csv(df: DataFrame, path: str, order: str = "event_id", limit: int = 5000) -> None:
    df.orderBy(F.desc(order)).limit(limit).write.mode("overwrite").option("header", True).csv(path)


def training_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def metrics_json(rows: DataFrame) -> str:
    """A bounded metric table as one JSON document."""
    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], default=str, sort_keys=True)


def run_row(summary: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Named values out of a nested summary, and the whole as JSON."""
    return summary.select(*[F.col(path).alias(name) for name, path in columns.items()], F.to_json(F.struct("*")).alias("summary_json"))
