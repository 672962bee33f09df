"""All queries over the provided tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textwarden.plans import build_queries, curve_queries, data_queries, event_queries, file_queries, layer_queries, loader_queries, model_queries, page_queries, stream_queries, tagger_queries, text_queries, token_queries
from textwarden.plans.common import Query, reader

ALL: dict[str, Query] = text_queries.QUERIES | data_queries.QUERIES | model_queries.QUERIES | event_queries.QUERIES | layer_queries.QUERIES | loader_queries.QUERIES | build_queries.QUERIES | token_queries.QUERIES | tagger_queries.QUERIES | page_queries.QUERIES | stream_queries.QUERIES | curve_queries.QUERIES | file_queries.QUERIES


def _bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(reader(spark, sf_dir), spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _bind(q) for n, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in ALL.items() if q.sql} | loader_queries.MORE_SQL
