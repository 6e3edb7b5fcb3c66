"""Queries of the specification's checklist and of findings that wait on a stream, with SQL twins written from the specification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.review import review
from ..operators.spec_checklist import READS, spec_checklist
from ..streaming import pending_stream
from .review_queries import _IMPACT_UNSUPPORTED, _MILD, ESCALATED, ISSUES, LABEL, STATUS, _like
from .synthetic import EVIDENCE_SQL, FINDINGS_SQL, TITLES, WITH, case, findings, table

c = F.col

#: Every ninth finding is one that finds nothing: no other kind of ours waits for anything.
_QUIET = "doc_id % 9 = 4"
_TITLE = case("doc_id % 8", [t for _, t in TITLES])
_TARGETS = "CASE doc_id % 5 WHEN 0 THEN array() WHEN 1 THEN array(named_struct('target_type', 'web_application', 'value', 'https://a.example')) WHEN 2 THEN array(named_struct('target_type', 'api', 'value', ' N/A')) WHEN 3 THEN array(named_struct('target_type', 'network', 'value', '10.0.0.1')) END"


def _findings(s, d):
    f = findings(s, d)
    quiet = F.expr(_QUIET)
    item = F.expr(f"array(named_struct('evidence_id', finding_id || '-EVID-001', 'evidence_type', 'manual_observation', 'description', CAST(NULL AS STRING), 'content', {_TITLE} || ': no evidence was found of abuse'))")
    return f.withColumns({
        "severity": F.when(quiet, "medium").otherwise(c("severity")), "cvss": F.struct(F.when(quiet, 5.0).otherwise(c("score")).alias("score"), c("vector")), "evidence": F.when(quiet, item).otherwise(c("evidence")),
        "affected_targets": F.expr(_TARGETS).cast("array<struct<target_type:string,value:string>>"), "severity_override_reason": F.expr("CASE WHEN doc_id % 4 = 1 THEN 'agreed with the client' END"), "recheck_round": F.expr("CAST(doc_id % 2 AS INT)"),
    })


def _checked(s, d):
    return spec_checklist(review(_findings(s, d), keep=["affected_targets", "severity_override_reason", "recheck_round"], only=READS))


def _of(i: int):
    return lambda x: x.check_id == f"SV-{i:03d}"


def _spec(s, d):
    actions = [F.get(F.transform(F.filter("checklist", _of(i)), lambda x: x.action), F.lit(0)).alias(f"sv{i}") for i in range(1, 9)]
    return _checked(s, d).select(
        "finding_id", *actions, "overall_action", F.size("data_requests").cast("long").alias("n_requests"), F.array_join("recheck_items", ",").alias("recheck_items"), "pending.reason", "pending.resume_condition",
        F.array_join("escalation_reasons", "; ").alias("escalation_reasons"), "escalation_reviewer", "false_positive_probability", "validated_status",
    )


def _requests(s, d):
    return _checked(s, d).select("finding_id", F.explode("data_requests").alias("x")).groupBy("x.field", "x.urgency", "x.suggested_format").agg(F.count("*").alias("n"))


def _waited(s, d):
    """Two runs of the stream on one checkpoint: checks and early events first, then events and a second check of some."""
    root = s.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = f"{root.rstrip('/')}/pending-{uuid.uuid4().hex}"
    at = lambda minute: F.lit(f"2024-01-01 00:{minute:02d}:00")
    checks = pending_stream.as_changes(_checked(s, d), at(5))
    docs = table(s, d, "documents").select("doc_id", F.expr("'FND-' || lpad(CAST(doc_id AS STRING), 6, '0')").alias("finding_id"))
    none = F.lit(None).cast("string")
    event = lambda rows, name, minute: rows.select("finding_id", at(minute).cast("timestamp").alias("at"), F.lit("event").alias("kind"), none.alias("action"), none.alias("reason"), F.lit(None).cast("array<string>").alias("resume_events"), F.lit(name).alias("event"))
    again = docs.where("doc_id % 6 = 5").select("finding_id", at(20).cast("timestamp").alias("at"), F.lit("check").alias("kind"), F.lit("pass").alias("action"), none.alias("reason"), F.lit(None).cast("array<string>").alias("resume_events"), none.alias("event"))
    batches = [
        checks.unionByName(event(docs.where("doc_id % 10 = 9"), "manual_verification_added", 1)),
        event(docs.where("doc_id % 3 = 0"), "retest_completed", 10).unionByName(event(docs.where("doc_id % 3 = 1"), "mail_received", 10)).unionByName(again),
    ]
    for rows in batches:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = s.readStream.schema(pending_stream.CHANGES).parquet(f"{base}/in")
        pending_stream.run_pending(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return s.read.schema(pending_stream.OUTCOMES).parquet(f"{base}/out").select("finding_id", "change", "reason", "event", F.date_format("at", "HH:mm").alias("at"))


QUERIES = {"spec_checklist": _spec, "data_requests": _requests, "pending_resumed": _waited}

_SPEC_WITH = f"""WITH findings AS (SELECT * REPLACE (CASE WHEN {_QUIET} THEN 'medium' ELSE severity END AS severity, CASE WHEN {_QUIET} THEN 5.0 ELSE score END AS score, CASE WHEN {_QUIET} THEN 1 ELSE n_evidence END AS n_evidence) FROM ({FINDINGS_SQL})),
 evidence AS (SELECT * REPLACE (CASE WHEN {_QUIET} THEN 'manual_observation' ELSE evidence_type END AS evidence_type, CASE WHEN {_QUIET} THEN {_TITLE} || ': no evidence was found of abuse' ELSE content END AS content) FROM ({EVIDENCE_SQL}))"""
_VERBS, _SEEN = ["navigate", "submit", "configure", "extract", "attach", "run", "send"], ["observe", "confirm", "verify", "should see"]
_LEVEL = "CASE {} WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_SPEC = f"""{ESCALATED.replace(WITH, _SPEC_WITH)}, steps AS (SELECT finding_id, count(*) AS n_steps, count_if({_like('lower(content)', _VERBS)}) AS verbs, count_if({_like('lower(content)', _SEEN)}) AS seen FROM evidence WHERE evidence_type = 'reproduction_steps' GROUP BY 1),
told AS (SELECT x.*, {STATUS} AS review_status, {LABEL} AS lbl, coalesce(severity IN ('critical', 'high'), false) AS serious, doc_id % 5 IN (0, 4) AS untargeted, doc_id % 5 = 2 AS unnamed, doc_id % 2 = 1 AS again, doc_id % 4 = 1 AS override,
    regexp_matches(obs, 'https?://[^\\s"''<>]') OR regexp_matches(obs, '\\b\\d{{1,3}}(\\.\\d{{1,3}}){{3}}\\b') AS named, coalesce(n_steps, 0) AS n_steps, coalesce(verbs, 0) AS verbs, coalesce(seen, 0) AS seen, {ISSUES['CONS-006'].replace('judged.finding_id', 'x.finding_id')} AS elsewhere,
    imp <> '' AND ({_IMPACT_UNSUPPORTED}) AS claims, {_MILD} AS mild, coalesce(severity <> band, false) AS mismatch, {_LEVEL.format('severity')} < {_LEVEL.format('band')} AS under, coalesce({_LEVEL.format('severity')} < 2, false) AS mean_level FROM escalated x LEFT JOIN steps USING (finding_id)),
scored7 AS (SELECT *, CASE WHEN scanner > 0 AND manual = 0 THEN 0.9 WHEN contains(ev, 'no evidence was found') OR (serious AND (contains(ev, 'no successful exploitation') OR contains(obs, 'no successful exploitation'))) THEN 0.6 ELSE 0.1 END::DOUBLE AS fp FROM told),
acted AS (SELECT *, CASE WHEN (untargeted OR unnamed) AND serious THEN 'escalate' WHEN untargeted AND named AND NOT again THEN 'recheck' WHEN untargeted OR unnamed THEN 'request_data' ELSE 'pass' END AS sv1,
    CASE WHEN n = 0 THEN 'request_data' WHEN scanner > 0 AND manual = 0 THEN 'escalate' ELSE 'pass' END AS sv2,
    CASE WHEN refuted > 0 AND success > 0 THEN 'escalate' WHEN elsewhere THEN 'escalate' WHEN refuted > 0 OR NOT coalesce(sufficient, false) THEN 'request_data' ELSE 'pass' END AS sv3,
    CASE WHEN n_steps = 0 THEN 'request_data' WHEN verbs = 0 OR seen = 0 THEN 'warn' ELSE 'pass' END AS sv4,
    CASE WHEN imp = '' THEN 'request_data' WHEN claims AND NOT again THEN 'recheck' WHEN claims THEN 'warn' WHEN mild THEN 'warn' ELSE 'pass' END AS sv5,
    CASE WHEN mismatch AND NOT override THEN 'escalate' WHEN lbl = 'confirmed_vulnerability' AND mean_level THEN 'escalate' WHEN mismatch THEN 'warn' ELSE 'pass' END AS sv6,
    CASE WHEN fp >= 0.9 THEN 'escalate' WHEN fp >= 0.6 THEN 'pending' ELSE 'pass' END AS sv7,
    CASE WHEN refuted > 0 AND success = 0 AND again THEN 'escalate' WHEN refuted > 0 AND success = 0 THEN 'recheck' WHEN claims AND NOT again THEN 'recheck' WHEN claims OR refuted > 0 THEN 'warn' ELSE 'pass' END AS sv8 FROM scored7),
summed AS (SELECT *, [sv1, sv2, sv3, sv4, sv5, sv6, sv7, sv8] AS svs, CASE WHEN list_contains(svs, 'escalate') THEN 'escalate' WHEN list_contains(svs, 'pending') THEN 'pending' WHEN list_contains(svs, 'request_data') THEN 'request_data' WHEN list_contains(svs, 'recheck') THEN 'recheck' WHEN list_contains(svs, 'warn') THEN 'warn' ELSE 'pass' END AS overall_action FROM acted)"""
_WAITS = "'Moderate false positive risk, awaiting additional verification'"

ORACLE_SQL = {
    "spec_checklist": f"""{_SPEC} SELECT finding_id, sv1, sv2, sv3, sv4, sv5, sv6, sv7, sv8, overall_action, length(list_filter(svs, lambda x: x = 'request_data'))::BIGINT AS n_requests,
        concat_ws(',', CASE WHEN sv1 = 'recheck' THEN 'SV-001' END, CASE WHEN sv5 = 'recheck' THEN 'SV-005' END, CASE WHEN sv8 = 'recheck' THEN 'SV-008' END) AS recheck_items, CASE WHEN overall_action = 'pending' THEN {_WAITS} END AS reason,
        CASE WHEN overall_action = 'pending' THEN 'manual_verification_provided OR retest_completed' END AS resume_condition,
        concat_ws('; ', CASE WHEN sv1 = 'escalate' THEN 'Serious finding without an identifiable asset' END, CASE WHEN sv2 = 'escalate' THEN 'Scanner-only finding requires human verification' END,
            CASE WHEN refuted > 0 AND success > 0 THEN 'Evidence contradicts vulnerability claim' WHEN elsewhere THEN 'Evidence appears to describe a different vulnerability' END,
            CASE WHEN mismatch AND NOT override AND under THEN 'Severity underrated, the score implies a higher one' WHEN mismatch AND NOT override THEN 'Severity overrated, the score implies a lower one' WHEN sv6 = 'escalate' THEN 'Confirmed vulnerability below medium severity' END,
            CASE WHEN sv7 = 'escalate' THEN 'High false positive probability, scanner only' END, CASE WHEN sv8 = 'escalate' THEN 'The main claim lacks evidence after a re-check' END) AS escalation_reasons,
        CASE WHEN sv1 = 'escalate' THEN 'senior_pentester' WHEN sv2 = 'escalate' THEN 'technical_reviewer' WHEN refuted > 0 AND success > 0 THEN 'senior_pentester' WHEN sv3 = 'escalate' THEN 'technical_reviewer' WHEN mismatch AND NOT override THEN 'report_reviewer' WHEN sv6 = 'escalate' THEN 'senior_pentester'
            WHEN sv7 = 'escalate' OR sv8 = 'escalate' THEN 'technical_reviewer' END AS escalation_reviewer, fp AS false_positive_probability,
        CASE overall_action WHEN 'escalate' THEN 'human_review' WHEN 'pending' THEN 'pending' WHEN 'request_data' THEN 'needs_revision' ELSE review_status END AS validated_status FROM summed""",
    "data_requests": f"""{_SPEC}, asked AS (SELECT CASE WHEN untargeted THEN 'affected_targets' ELSE 'affected_targets[0].value' END AS field, 'medium' AS urgency, CASE WHEN untargeted THEN 'target type and identifier' ELSE 'address, host or package name' END AS suggested_format FROM summed WHERE sv1 = 'request_data'
        UNION ALL SELECT 'evidence', 'high', 'reproduction_steps or manual_verification_notes' FROM summed WHERE sv2 = 'request_data' UNION ALL SELECT 'evidence', 'medium', 'evidence of exploitation' FROM summed WHERE sv3 = 'request_data'
        UNION ALL SELECT 'evidence', 'medium', 'reproduction_steps' FROM summed WHERE sv4 = 'request_data' UNION ALL SELECT 'impact', 'medium', 'finding-specific impact' FROM summed WHERE sv5 = 'request_data')
        SELECT field, urgency, suggested_format, count(*) AS n FROM asked GROUP BY 1, 2, 3""",
    "pending_resumed": f"""{_SPEC}, waiting AS (SELECT doc_id, finding_id, {_WAITS} AS reason FROM summed WHERE overall_action = 'pending')
        SELECT finding_id, 'resumed' AS change, reason, 'manual_verification_added' AS event, '00:05' AS at FROM waiting WHERE doc_id % 10 = 9 UNION ALL SELECT finding_id, 'held', reason, NULL, '00:05' FROM waiting WHERE doc_id % 10 <> 9
        UNION ALL SELECT finding_id, 'resumed', reason, 'retest_completed', '00:10' FROM waiting WHERE doc_id % 10 <> 9 AND doc_id % 3 = 0 UNION ALL SELECT finding_id, 'closed', reason, NULL, '00:20' FROM waiting WHERE doc_id % 10 <> 9 AND doc_id % 6 = 5""",
}
