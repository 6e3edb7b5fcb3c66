"""Queries of self-validation, schema validation, migration and streaming, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import migration, selfcheck, validation
from ..operators.review import review
from ..streaming import review_stream
from .review_queries import _VALID, ESCALATED, ISSUES, STATUS, _sql_codes
from .synthetic import case, findings, quoted, table

c = F.col


def _checked(s, d):
    return selfcheck.checklist(review(findings(s, d), only=selfcheck.READS))


RAW = f"""CASE doc_id % 9 WHEN 0 THEN '{{"finding_id": "FND-000001", "title": "x", "severity": "low", "score": 3.5}}' WHEN 1 THEN '{{"finding_id": "F-1", "title": "x", "severity": "bad", "score": 11}}'
 WHEN 2 THEN 'not json' WHEN 3 THEN '{{"finding_id": "FND-000002", "title": "", "severity": null, "score": null, "extra": 1}}' WHEN 4 THEN '{{"title": null, "severity": "high", "score": -1}}'
 WHEN 5 THEN '[1]' WHEN 6 THEN '{{"finding_id": "FND-000003", "title": 5, "severity": "low", "score": "9", "roles": ["a", "a"]}}' WHEN 7 THEN '{{"finding_id": "FND-000004", "title": "t", "severity": "low", "score": 0, "roles": {{}}}}' ELSE '{{"finding_id": null, "title": "t", "severity": "low", "score": 10}}' END"""
#: What must be found for each kind of record above, by hand.
EXPECTED = {
    1: [("finding_id", "does not match the pattern"), ("score", "is over the maximum"), ("severity", "is not one of the listed values")],
    2: [("<root>", "is not JSON")],
    3: [("<root>", "has additional properties"), ("title", "is too short")],
    4: [("<root>", "lacks required property finding_id"), ("score", "is under the minimum")],
    5: [("<root>", "is not of type object")],
    6: [("roles", "has repeated items"), ("score", "is not of type number or null"), ("title", "is not of type string or null")],
    7: [("roles", "is not of type array")],
    8: [("finding_id", "is not of type string")],
}


def _records(s, d):
    return table(s, d, "documents").select("doc_id", F.expr(RAW).alias("raw"))


def _streamed(s, d):
    """Reviews of a stream over the documents' file, run to its end into a scratch folder of the session."""
    import uuid

    batch = findings(s, d)
    root = s.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    batch.write.parquet(f"{base}/in")
    stream = review_stream.review_stream(review_stream.files_as_stream(s, f"{base}/in", batch)).select("finding_id", "review_status", "confidence.score")
    review_stream.run_once(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return s.read.schema("finding_id string, review_status string, score double").parquet(f"{base}/out")


QUERIES = {
    "selfcheck_items": lambda s, d: _checked(s, d).select("finding_id", F.explode("checklist").alias("x")).select("finding_id", "x.item", "x.action"),
    "response_action": lambda s, d: _checked(s, d).select("finding_id", "overall_action", c("failed").cast("long").alias("failed")),
    "false_positive_probability": lambda s, d: review(findings(s, d), only=["evidence_review", "consistency"]).select("finding_id", selfcheck.false_positive_probability().alias("probability")),
    "schema_errors": lambda s, d: validation.errors(_records(s, d), "doc_id", "raw", validation.FINDING_SCHEMA),
    "schema_first_error": lambda s, d: validation.first_error(_records(s, d), "doc_id", "raw", validation.FINDING_SCHEMA),
    "backfill": lambda s, d: migration.backfill(_records(s, d), "raw", {"title": "untitled", "owner": "nobody"}).select("doc_id", "title", "owner"),
    "upsert": lambda s, d: migration.upsert(table(s, d, "customer").select("c_custkey", "c_mktsegment"), table(s, d, "customer").where("c_custkey % 10 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")), "c_custkey"),
    "review_streamed": _streamed,
}

_CONFIRMED = "label = 'confirmed_vulnerability'"
_CONDITIONAL = "rec = '' OR score IS NULL OR cwe_id IS NULL OR impact IS NULL"
CHECKED = f"""{ESCALATED}, told AS (SELECT *, {_sql_codes([(v, k) for k, v in ISSUES.items()]).replace("judged.finding_id", "escalated.finding_id")} AS issues FROM escalated),
listed AS (
 SELECT finding_id, 'completeness' AS item, CASE WHEN severity IS NULL OR observation = '' OR n = 0 THEN 'request_data' WHEN {_CONDITIONAL} THEN 're-check' ELSE 'pass' END AS action FROM told
 UNION ALL SELECT finding_id, 'evidence', CASE WHEN sufficient IS NULL THEN 'request_data' WHEN sufficient AND refuted = 0 THEN 'pass' WHEN manual = 0 THEN 'request_data' WHEN refuted > 0 THEN 'pending' ELSE 're-check' END FROM told
 UNION ALL SELECT finding_id, 'classification', CASE WHEN NOT {_CONFIRMED} AND confidence_score < 0.5 THEN 'pending' ELSE 'pass' END FROM told
 UNION ALL SELECT finding_id, 'severity', CASE WHEN coalesce(vector, '') <> '' AND NOT {_VALID} THEN 're-check' WHEN severity <> band THEN 'escalate' ELSE 'pass' END FROM told
 UNION ALL SELECT finding_id, 'cross_field', CASE WHEN issues = '' THEN 'pass' WHEN contains(issues, 'CONS-005') OR contains(issues, 'CONS-006') THEN 'escalate' ELSE 're-check' END FROM told
 UNION ALL SELECT finding_id, 'scanner_trap', CASE WHEN scanner = 0 OR coalesce(sufficient, false) THEN 'pass' WHEN {_CONFIRMED} OR coalesce(severity IN ('critical', 'high'), false) THEN 'escalate' ELSE 'request_data' END FROM told
 UNION ALL SELECT finding_id, 'confidence', CASE WHEN reasons <> '' THEN 'escalate' ELSE 'pass' END FROM told
 UNION ALL SELECT finding_id, 'retest', CASE WHEN retest_status = 'fixed' AND retest_items = 0 THEN 'request_data' WHEN retest_status IN ('partially_fixed', 'not_fixed') THEN 'pending' WHEN {_CONFIRMED} AND coalesce(retest_status, 'not_retested') = 'not_retested' THEN 'pending' ELSE 'pass' END FROM told)"""
_ERRORS = ", ".join(f"({kind}, {quoted(p)}, {quoted(m)})" for kind, found in EXPECTED.items() for p, m in found)

ORACLE_SQL = {
    "selfcheck_items": f"{CHECKED} SELECT * FROM listed",
    "response_action": f"{CHECKED} SELECT finding_id, arg_max(action, CASE action WHEN 'escalate' THEN 4 WHEN 'pending' THEN 3 WHEN 'request_data' THEN 2 WHEN 're-check' THEN 1 ELSE 0 END) AS overall_action, count_if(action <> 'pass')::BIGINT AS failed FROM listed GROUP BY 1",
    "false_positive_probability": f"{CHECKED} SELECT finding_id, CASE WHEN scanner > 0 AND NOT coalesce(sufficient, false) THEN 0.9 WHEN refuted > 0 OR contains(issues, 'CONS-006') THEN 0.6 ELSE 0.1 END::DOUBLE AS probability FROM told",
    "schema_errors": f"SELECT doc_id, path, message FROM documents JOIN (VALUES {_ERRORS}) AS e(kind, path, message) ON doc_id % 9 = kind",
    "schema_first_error": f"SELECT doc_id, min(path) AS path, arg_min(message, path) AS message FROM documents JOIN (VALUES {_ERRORS}) AS e(kind, path, message) ON doc_id % 9 = kind GROUP BY 1",
    "backfill": f"SELECT doc_id, {case('doc_id % 9', ['x', 'x', 'untitled', '', None, 'untitled', '5', 't', 't'])} AS title, 'nobody' AS owner FROM documents",
    "upsert": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "review_streamed": f"{ESCALATED} SELECT finding_id, {STATUS} AS review_status, confidence_score AS score FROM escalated",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
