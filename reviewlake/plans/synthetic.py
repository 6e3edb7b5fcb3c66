"""Synthetic findings over ``documents``: integer arithmetic on doc_id only, so that Spark and DuckDB build the same rows.

``FINDINGS_SQL`` runs on both engines. Evidence is one row per item in SQL (``EVIDENCE_SQL`` for
DuckDB) and an array per finding in Spark (``findings``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    ("CWE-798", "Hardcoded broker credential in mobile package"), ("CWE-327", "Broken signing algorithm accepted by token check"),
    ("CWE-693", "Root detection bypass on rooted device"), ("CWE-295", "Certificate pinning absent in transport layer"),
    ("CWE-204", "Account enumeration through differing replies"), ("CWE-79", "Stored script injection in comment box"),
    ("CWE79", "Malformed weakness label in record"), (None, "Debug endpoint reachable without login"),
]
CONTENTS = [
    "Tester successfully gained access with the hardcoded credential",
    "Scanner listed open ports only",
    "The signing algorithm was confirmed but no evidence was found of abuse",
    "Certificate pinning bypass was not demonstrated on the device",
    "Account enumeration verified through differing replies",
    "Script injection payload stored in the comment box, unauthorized data exposure",
]
TYPES = ["reproduction_steps", "scanner_output", "screenshot", "command_output", "manual_observation"]
IMPACTS = [
    "Unauthorized access to the entire system with complete takeover", "Minor cosmetic effect", "Limited information disclosure for certain users",
    None, "Some exposure of sensitive data and bypass of the login for all users of the service", "Little effect on small parts",
]
RECOMMENDATIONS = [
    "Remove the hardcoded credential|Rotate the secret in a vault", "Follow best practices", "", "Replace the algorithm with an asymmetric one|Review key management",
    "Enforce certificate validation", "Talk to the vendor|Wait for news", "Normalize the error message and response",
]
STATUSES = [None, "not_retested", "fixed", "partially_fixed", "not_fixed", "accepted_risk", "someday"]
SEVERITIES = ["critical", "high", "medium", "low", "informational", "unknown", None]
VECTORS = ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:C/C:L/I:N/A:N", "AV:N/AC:L", None]


def quoted(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "''") + "'"


def case(expression: str, values: list) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


FINDINGS_SQL = f"""
SELECT doc_id,
       'FND-' || lpad(CAST(doc_id AS STRING), 6, '0') AS finding_id,
       'DOC-' || lpad(CAST(doc_id % 40 AS STRING), 6, '0') AS document_id,
       source AS engagement_id,
       {case("doc_id % 8", [t for _, t in TITLES])} AS title,
       {case("doc_id % 7", SEVERITIES)} AS severity,
       CASE WHEN doc_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((doc_id * 37) % 1001 AS DOUBLE) / 100 END AS score,
       {case("doc_id % 4", VECTORS)} AS vector,
       {case("doc_id % 8", [w for w, _ in TITLES])} AS cwe_id,
       {case("doc_id % 6", IMPACTS)} AS impact,
       CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 3 = 0 THEN {case("doc_id % 8", [t for _, t in TITLES])} || ' was observed on the device' ELSE text END AS observation,
       {case("doc_id % 7", RECOMMENDATIONS)} AS recommendation_text,
       CASE doc_id % 5 WHEN 0 THEN CAST(NULL AS BOOLEAN) WHEN 1 THEN false ELSE true END AS retest_applicable,
       {case("doc_id % 7", STATUSES)} AS retest_status,
       CAST(CASE WHEN doc_id % 9 < 4 THEN 1 ELSE 0 END AS INT) AS retest_items,
       CAST(doc_id % 4 AS INT) AS n_evidence,
       CASE WHEN doc_id % 11 = 0 THEN CAST(NULL AS BOOLEAN) ELSE doc_id % 6 <> 0 END AS usage_approved,
       {case("doc_id % 3", ["internal", "evaluation_only", "public"])} AS usage_scope,
       {case("doc_id % 5", ["provider_preprocessed", "automated_check_passed", "manual_check_passed", "not_applicable", "raw"])} AS redaction_status
FROM documents
"""

EVIDENCE_SQL = f"""
SELECT finding_id, doc_id, i, finding_id || '-EVID-' || lpad(CAST(i AS STRING), 3, '0') AS evidence_id,
       {case("(doc_id + i) % 5", TYPES)} AS evidence_type,
       {case("(doc_id + i) % 6", CONTENTS)} AS content
FROM findings, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= n_evidence
"""

#: Common start of the SQL twins: findings and their evidence, lower-cased texts included.
WITH = f"WITH findings AS ({FINDINGS_SQL}), evidence AS ({EVIDENCE_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FINDINGS_SQL.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested findings as the review expects them."""
    flat = flat_findings(spark, sf_dir)
    item = f"""transform(filter(array(1, 2, 3), i -> i <= n_evidence), i -> named_struct(
        'evidence_id', finding_id || '-EVID-' || lpad(CAST(i AS STRING), 3, '0'),
        'evidence_type', {case("(doc_id + i) % 5", TYPES)},
        'description', CAST(NULL AS STRING),
        'content', {case("(doc_id + i) % 6", CONTENTS)}))"""
    return flat.withColumns({
        "cvss": F.struct("score", "vector"),
        "evidence": F.expr(item),
        "recommendation": F.when(F.col("recommendation_text") == "", F.array().cast("array<string>")).otherwise(F.split("recommendation_text", r"\|")),
        "retest": F.struct(F.col("retest_applicable").alias("applicable"), F.col("retest_status").alias("status"), F.expr("if(retest_items > 0, array('shown'), array())").cast("array<string>").alias("evidence")),
    })
