"""The review on a stream: every rule is row-local, so the batch plan applies unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import review


def review_stream(findings: DataFrame) -> DataFrame:
    """Reviews of a streaming DataFrame of findings."""
    return review(findings)


def files_as_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_once(reviews: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, to Parquet."""
    return reviews.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def review_counts(findings: DataFrame, valid: str = "is_valid", at: str = "seen_at", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(window_start, outcome, n) on a stream: reviews by status and invalid findings as ``error``, each finding counted once.

    ``findings`` has a boolean that tells whether the finding may be reviewed, and a time. A finding that comes again within ``late`` of its first time,
    in another file or after a restart, is not counted again; state older than that is let go. A window is given out once no row of it can come any more.
    """
    once = findings.withWatermark(at, late).dropDuplicatesWithinWatermark(["finding_id"])
    reviewed = review(once, only=["review_status"], keep=[valid, at])
    outcome = F.when(F.coalesce(F.col(valid), F.lit(False)), F.col("review_status")).otherwise("error")
    counted = reviewed.groupBy(F.window(at, window).alias("w"), outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "outcome", "n")
