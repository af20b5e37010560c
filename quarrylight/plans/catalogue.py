"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.session import prepare

from . import claim_queries, evaluation_queries, grounding_queries, knowledge_queries, metric_queries, packet_queries, retrieval_queries, text_queries, verification_queries, window_queries

MODULES = (text_queries, retrieval_queries, claim_queries, window_queries, knowledge_queries, grounding_queries, packet_queries, metric_queries, verification_queries, evaluation_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["relevance_density"](spark, sf_dir)


def _ready(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _ready(f) for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
