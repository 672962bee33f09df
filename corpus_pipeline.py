"""A training corpus from documents: five stages, each by one of the corpus operators.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``docs``; the last adds ``copy``. :func:`run` writes each stage's
result as Parquet to the shared folder and reads it again for the next.

ORACLE_SQL is None: the first stage is a trained model. Tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import decontamination, jaccard_join, mixing, substring_dedup, toxicity
from textwarden.llm.queries import toxicity_model
from textwarden.llm.storage import loosened, stored


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """The columns an operator needs, and the whole row as one column, so that no other name can clash."""
    return loosened(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *named))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from the labels of ``sf_dir``."""
    scored = toxicity.score(_packed(docs, "text"), toxicity_model(spark, sf_dir))
    return scored.where(F.col("toxic_score") < toxicity.THRESHOLD).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, similarity 0.8) the row with the smallest id; of repeated
    rows one, where other columns differ always the same. Rows with a null id stay. Rows that share an id with a row of another
    text are told apart by their texts."""
    groups = jaccard_join.memberships(docs.select("doc_id", "text"), n=5, percent=80).where("doc_id IS NOT NULL")
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    alone = groups.where("component IS NULL").select("doc_id", "text_key").distinct()
    keyed = _packed(docs, "doc_id", F.xxhash64("text").alias("text_key"))
    kept = keyed.where("doc_id IS NOT NULL").join(first.unionByName(alone), ["doc_id", "text_key"], "left_semi")
    kept = kept.groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64(F.col("row").cast("string"))).alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def remove_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 35 words or more that also occur elsewhere."""
    cut = substring_dedup.remove_repeats(_packed(docs, "doc_id", "text"), width=35, carry="row")
    kept = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": kept, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that matches an item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find(_packed(docs, "text"), items).where(F.size("matches") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets ask for."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", one_of_each_group),
    ("substring dedup", remove_shared_passages),
    ("decontamination", reject_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
