"""The severity bands of a CVSS score; variants differ in gaps (8.95, 3.95) and nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import CVSS_BANDS


def _closed(score: Column) -> Column:
    out = None
    for name, low, high in CVSS_BANDS:
        inside = (score >= low) & (score <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def review_band(score: Column) -> Column:
    """Gaps are ``unknown``, null stays null."""
    return F.when(score.isNull(), None).otherwise(F.coalesce(_closed(score), F.lit("unknown")))


def quality_band(score: Column) -> Column:
    """Gaps and null give null."""
    return _closed(score)


def benchmark_band(score: Column) -> Column:
    """Null and 0 are informational; what the closed bands leave out is low."""
    return F.when(score.isNull() | (score == 0), "informational").otherwise(F.coalesce(_closed(score), F.lit("low")))


def merge_band(score: Column) -> Column:
    """Half-open from above; under 0.1 informational."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").when(score.isNotNull(), "informational")


def hard_negative_band(score: Column) -> Column:
    """Half-open; 0 informational."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0.0, "low").when(score.isNotNull(), "informational")
