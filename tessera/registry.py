"""Every query of the package and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import decision_queries, feature_queries, model_queries, retrieval_queries, text_queries

MODULES = (text_queries, retrieval_queries, feature_queries, decision_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.R.sql.items()}
