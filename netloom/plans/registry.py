"""All named queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.plans import audit_queries, candidate_queries, detector_queries, display_queries, flow_queries, fold_queries, forensic_queries, function_queries, payload_queries, quality_queries, report_queries, selection_queries
from netloom.plans.base import Query


def _all() -> dict[str, Query]:
    return flow_queries.QUERIES | audit_queries.QUERIES | quality_queries.QUERIES | fold_queries.QUERIES | display_queries.QUERIES | candidate_queries.QUERIES | detector_queries.QUERIES | forensic_queries.QUERIES | function_queries.QUERIES | payload_queries.QUERIES | report_queries.QUERIES | selection_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _all().items() if q.sql}
