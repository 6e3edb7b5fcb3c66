"""Registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import check_queries, checklist_queries, dataset_queries, finding_queries, record_queries, review_queries, table_queries, text_queries

MODULES = [review_queries, table_queries, finding_queries, dataset_queries, record_queries, check_queries, checklist_queries, text_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, confidence and escalation of every finding."""
    from ..operators.review import review
    from .synthetic import findings

    return review(findings(spark, sf_dir), only=["review_status", "classification", "confidence", "escalation"]).select("finding_id", "review_status", "classification.label", "confidence.score", "confidence.level", "escalation.required", "escalation.reviewer")
