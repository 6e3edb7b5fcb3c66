"""Review queries: one per rule, with SQL twins over findings and evidence rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import review as R
from .synthetic import WITH, findings, quoted

c = F.col


def _like(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def _in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def _words(column: str, words: dict, text: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {_like(text, w)}" for k, w in words.items()) + " END"


BAND = "CASE WHEN score IS NULL THEN NULL WHEN score BETWEEN 9.0 AND 10.0 THEN 'critical' WHEN score BETWEEN 7.0 AND 8.9 THEN 'high' WHEN score BETWEEN 4.0 AND 6.9 THEN 'medium' WHEN score BETWEEN 0.1 AND 3.9 THEN 'low' WHEN score = 0.0 THEN 'informational' ELSE 'unknown' END"
ITEMS = f"""items AS (SELECT finding_id, count(*) AS n, count_if(evidence_type IN {_in(V.MANUAL_EVIDENCE)}) AS manual,
    count_if({_like("lower(' ' || content)", V.EXPLOIT_SIGNALS)}) AS success, count_if({_like("lower(' ' || content)", V.NO_EXPLOIT_SIGNALS)}) AS refuted,
    count_if(evidence_type = 'scanner_output') AS scanner, string_agg(lower(' ' || content), ' ' ORDER BY i) AS text FROM evidence GROUP BY finding_id)"""
KW = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(%s), '[^a-z0-9\\s_-]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(quoted(w) for w in V.STOP_WORDS)}], w))"
OWN = "CASE severity " + " ".join(f"WHEN {quoted(k)} THEN {_like('imp', w)}" for k, w in V.SEVERITY_IMPACT.items()) + " ELSE true END"
BASE = f"""{WITH}, {ITEMS}, joined AS (
    SELECT f.*, {BAND} AS band, lower(coalesce(title, '')) AS ttl, lower(coalesce(observation, '')) AS obs, lower(coalesce(impact, '')) AS imp,
           lower(replace(recommendation_text, '|', ' ')) AS rec, coalesce(n, 0) AS n, coalesce(manual, 0) AS manual, coalesce(success, 0) AS success,
           coalesce(refuted, 0) AS refuted, coalesce(scanner, 0) AS scanner, coalesce(i.text, '') AS ev
    FROM findings f LEFT JOIN items i USING (finding_id)),
judged AS (
    SELECT *, CASE WHEN n = 0 THEN NULL ELSE success > 0 AND manual > 0 END AS sufficient,
           list_distinct_ordered(title_kw) AS tk, list_distinct_ordered(source_kw) AS sk
    FROM (SELECT *, {KW % "ttl"} AS title_kw, {KW % "(ttl || ' ' || obs)"} AS source_kw FROM joined))"""
# Distinct words only count and match, so their order does not matter here.
BASE = BASE.replace("list_distinct_ordered(", "list_distinct(")
LABEL = "CASE WHEN sufficient AND refuted = 0 THEN 'confirmed_vulnerability' ELSE 'potential_issue' END"
MISMATCH = "coalesce(severity <> band, false)"
HITS = "length(list_filter(%s, lambda w: contains(%s, w)))"
SUPPORTED = "coalesce(sufficient AND refuted = 0, false)"
ISSUES = {
    "CONS-001": MISMATCH,
    "CONS-003": f"coalesce(length(tk) > 0 AND obs <> '' AND {HITS % ('tk', 'obs')} / length(tk)::DOUBLE < 0.2, false)",
    "CONS-004": f"(rec <> '' AND (ttl <> '' OR obs <> '') AND NOT coalesce(list_bool_or(list_transform(list_filter(sk, lambda w: length(w) >= 4), lambda w: contains(rec, w))), false))",
    "CONS-005": f"coalesce(length(tk) > 0 AND n > 0 AND {HITS % ('tk', 'ev')} / length(tk)::DOUBLE < 0.25, false)",
    "CONS-006": f"(length(sk) > 0 AND coalesce((SELECT count(*) FROM evidence e WHERE e.finding_id = judged.finding_id AND {HITS % ('sk', 'lower(e.content)')} / length(sk)::DOUBLE < CASE WHEN evidence_type = 'scanner_output' THEN 0.05 ELSE 0.1 END), 0) > 0)",
    "CONS-007": f"(trim(imp) <> '' AND coalesce(severity, '') <> '' AND ((severity IN ('critical', 'high') AND NOT {_like('imp', V.STRONG_IMPACT)} AND NOT {OWN}) OR (severity IN ('low', 'informational') AND {_like('imp', V.STRONG_IMPACT)}) OR (NOT {OWN} AND length(regexp_split_to_array(trim(imp), '\\s+')) > 5)))",
}
FACTORS = """SELECT *, CASE WHEN sufficient IS NULL THEN 0.0 WHEN sufficient THEN 1.0 WHEN refuted > 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS f_evidence,
    CASE WHEN label = 'confirmed_vulnerability' THEN 1.0 ELSE 0.7 END::DOUBLE AS f_class,
    CASE WHEN severity IS NULL OR band IS NULL THEN 0.5 WHEN severity = band THEN 1.0 ELSE 0.2 END::DOUBLE AS f_cvss,
    CASE WHEN severity IS NULL OR observation = '' OR n = 0 THEN 0.3 WHEN rec = '' OR score IS NULL OR cwe_id IS NULL OR impact IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS f_sections,
    CASE WHEN retest_applicable = false THEN 1.0 WHEN retest_status IN ('fixed', 'partially_fixed', 'not_fixed', 'accepted_risk') THEN
         CASE WHEN retest_applicable AND retest_items > 0 THEN 1.0 ELSE 0.5 END WHEN retest_status IS NULL OR retest_status = 'not_retested' THEN 0.1 ELSE 0.3 END::DOUBLE AS f_retest
    FROM (SELECT *, """ + LABEL + """ AS label FROM judged)"""
SCORED = f"{BASE}, scored AS (SELECT *, round(f_evidence * 0.35 + f_class * 0.25 + f_cvss * 0.15 + f_sections * 0.15 + f_retest * 0.1, 3) AS confidence_score FROM ({FACTORS}))"
REASONS = [
    ("confidence_score < 0.7", "low_confidence"), ("f_evidence < 0.5", "weak_evidence"), ("coalesce(severity IN ('critical', 'high'), false)", "high_severity"),
    (MISMATCH, "severity_mismatch"), ("label = 'confirmed_vulnerability' AND coalesce(retest_status, 'not_retested') = 'not_retested'", "not_retested"),
]
ESCALATED = f"{SCORED}, escalated AS (SELECT *, concat_ws(',', {', '.join(f'CASE WHEN {cond} THEN {quoted(name)} END' for cond, name in REASONS)}) AS reasons FROM scored)"
STATUS = "CASE WHEN reasons <> '' THEN 'human_review' WHEN severity IS NULL OR observation = '' OR n = 0 OR sufficient = false THEN 'needs_revision' ELSE 'pass' END"


def _reviewed(spark, sf_dir, only=None, comments_of=None):
    return R.review(findings(spark, sf_dir), only=only, comments_of=comments_of)


def _pick(**columns):
    """Expressions over outputs of the review; only the rules that they name are built, and the comments of no other rule."""
    only = [x for x in R.OUTPUTS if any(re.search(rf"\b{x}\b", v) for v in columns.values())]
    rules = [x for x in only if x in R.NOTES]
    return lambda spark, sf_dir: _reviewed(spark, sf_dir, only, rules).select("finding_id", *[F.expr(v).alias(k) for k, v in columns.items()])


def _codes(prefix: str) -> str:
    return f"array_join(transform(filter(review_comments, x -> x.taxonomy_code like '{prefix}-%'), x -> x.taxonomy_code), ',')"


def _sql_codes(pairs) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN {quoted(code)} END" for cond, code in pairs) + ")"


QUERIES = {
    "review_completeness": _pick(is_complete="completeness.is_complete", missing_required="array_join(completeness.missing_required, ',')", missing_conditional="array_join(completeness.missing_conditional, ',')"),
    "review_evidence": _pick(is_sufficient="evidence_review.is_sufficient", n_unsupported="cast(size(evidence_review.unsupported) as bigint)", codes=_codes("EVID")),
    "review_classification": _pick(label="classification.label", supported="classification.supported_by_evidence", codes=_codes("CLASS")),
    "severity_review": _pick(reported="severity_review.reported", implied="severity_review.implied", is_consistent="severity_review.is_consistent", change_recommended="severity_review.change_recommended", suggested="severity_review.suggested"),
    "review_cvss": _pick(vector_valid="cvss_review.vector_valid", manual_recalculation="cvss_review.manual_recalculation", codes=_codes("CVSS")),
    "review_cwe": _pick(format_valid="cwe_review.format_valid", is_relevant="cwe_review.is_relevant", codes=_codes("CWE")),
    "review_impact": _pick(is_supported="impact_review.is_supported", is_proportionate="impact_review.is_proportionate", codes=_codes("IMP")),
    "review_recommendation": _pick(is_actionable="recommendation_review.is_actionable", addresses_root_cause="recommendation_review.addresses_root_cause", codes=_codes("REC")),
    "review_retest": _pick(supported="retest_review.supported", codes=_codes("RET")),
    "review_consistency": _pick(is_consistent="consistency.is_consistent", issues="array_join(consistency.issues, ',')"),
    "review_confidence": _pick(score="confidence.score", level="confidence.level", basis="array_join(confidence.basis, '; ')", limitations="array_join(confidence.limitations, '; ')"),
    "review_escalation": _pick(required="escalation.required", reasons="array_join(escalation.reasons, ',')", reviewer="escalation.reviewer"),
    "review_status": _pick(review_status="review_status"),
    "review_stats": lambda spark, sf_dir: R.review_stats(_reviewed(spark, sf_dir, ["review_status"])),
    "review_comments": lambda spark, sf_dir: _reviewed(spark, sf_dir, ["review_comments"]).select("finding_id", F.explode("review_comments").alias("x")).select("finding_id", "x.comment_id", "x.taxonomy_code", "x.category", "x.severity", "x.field", "x.suggested_action", "x.evidence_reference"),
    "review_comment_counts": lambda spark, sf_dir: _reviewed(spark, sf_dir, ["review_comments"]).select(F.explode("review_comments").alias("x")).groupBy("x.taxonomy_code", "x.category").agg(F.count("*").alias("n")),
}

_COMP = [("severity IS NULL", "severity"), ("observation = ''", "observation"), ("n = 0", "evidence")]
_COND = [("rec = ''", "recommendation"), ("score IS NULL", "cvss.score"), ("cwe_id IS NULL", "cwe_id"), ("impact IS NULL", "impact")]
_IMPACT_UNSUPPORTED = " OR ".join(f"(contains(imp, '{w}') AND NOT contains(ev, '{w}'))" for w in V.IMPACT_CLAIMS)
_MILD = f"(coalesce(severity IN ('critical', 'high'), false) AND NOT {_like('imp', V.STRONG_WORDS)})"
_RETEST = "CASE WHEN retest_applicable = false THEN 'none' WHEN retest_status IS NULL OR retest_status = 'not_retested' OR retest_applicable IS NULL THEN 'untested' WHEN retest_status IN ('fixed', 'partially_fixed', 'not_fixed', 'accepted_risk') THEN CASE WHEN retest_items > 0 THEN 'shown' ELSE 'unshown' END ELSE 'other' END"
_VALID = f"(coalesce(vector, '') <> '' AND regexp_matches(coalesce(vector, ''), '{V.CVSS_VECTOR}'))"
_CWE_HIT = _words("cwe_id", V.CWE_TITLE_WORDS, "ttl")
_ROOT = f"CASE WHEN rec <> '' THEN {_words('cwe_id', V.CWE_ROOT_CAUSES, 'rec')} END"
_CWE_OK = f"regexp_matches(cwe_id, '{V.CWE_ID}')"
#: Every comment in rule order: when, code, severity, field, action. Written from the rules' text; nothing here is shared with the operator.
_COMMENTS = [
    ("severity IS NULL", "COMP-001", "error", "severity", "provide_missing_content"),
    ("trim(observation) = ''", "COMP-001", "error", "observation", "provide_missing_content"),
    ("n = 0", "COMP-002", "error", "evidence", "provide_exploitation_evidence"),
    ("rec = ''", "COMP-003", "warning", "recommendation", "add_recommendation"),
    ("score IS NULL", "COMP-004", "warning", "cvss.score", "provide_cvss_score"),
    ("cwe_id IS NULL", "COMP-005", "warning", "cwe_id", "assign_cwe_id"),
    ("impact IS NULL", "COMP-006", "warning", "impact", "describe_impact"),
    *[(f"refuted >= {i}", "EVID-002", "warning", "evidence", "confirm_classification_as_potential_issue") for i in (1, 2, 3)],
    ("n = 0", "EVID-003", "error", "evidence", "provide_exploitation_evidence_or_downgrade"),
    ("n > 0 AND manual > 0 AND success = 0", "EVID-004", "warning", "evidence", "evaluate_evidence_strength_for_classification"),
    ("n > 0 AND manual = 0", "EVID-005", "warning", "evidence", "perform_manual_verification"),
    ("sufficient = false OR refuted > 0", "CLASS-001", "warning", "classification", "provide_additional_evidence_to_confirm"),
    ("sufficient IS NULL AND refuted = 0", "CLASS-002", "error", "classification", "provide_evidence_or_mark_as_informational"),
    (MISMATCH, "SEV-001", "warning", "severity", "review_with_human"),
    ("severity IS NULL", "SEV-002", "warning", "severity", "assign_severity"),
    (f"coalesce(vector, '') <> '' AND NOT {_VALID}", "CVSS-001", "warning", "cvss.vector", "verify_cvss_vector"),
    (MISMATCH, "CVSS-002", "warning", "cvss.score", "review_with_human"),
    (f"NOT {_CWE_OK}", "CWE-001", "warning", "cwe_id", "correct_cwe_id_format"),
    (f"{_CWE_OK} AND NOT {_CWE_HIT}", "CWE-002", "suggestion", "cwe_id", "verify_cwe_relevance"),
    ("cwe_id IS NULL", "CWE-003", "warning", "cwe_id", "assign_cwe_id"),
    (f"imp <> '' AND {_MILD}", "IMP-001", "suggestion", "impact", "review_impact_description"),
    ("imp = ''", "IMP-002", "warning", "impact", "describe_impact"),
    (f"rec <> '' AND NOT {_like('rec', V.ACTION_WORDS)}", "REC-001", "warning", "recommendation", "add_specific_actionable_steps"),
    (f"NOT ({_ROOT})", "REC-002", "warning", "recommendation", "add_root_cause_remediation"),
    ("rec = ''", "REC-003", "error", "recommendation", "add_recommendation"),
    (f"{_RETEST} = 'untested'", "RET-001", "suggestion", "retest", "schedule_retest"),
    (f"{_RETEST} = 'unshown'", "RET-002", "warning", "retest", "provide_retest_evidence"),
    (f"{_RETEST} = 'other'", "RET-003", "warning", "retest", "verify_retest_status"),
    (ISSUES["CONS-001"], "CONS-001", "warning", "severity", "review_with_human"),
    (ISSUES["CONS-003"], "CONS-003", "suggestion", "title", "review_title_accuracy"),
    (ISSUES["CONS-004"], "CONS-004", "suggestion", "recommendation", "strengthen_recommendation"),
    (ISSUES["CONS-005"], "CONS-005", "warning", "title", "verify_title_matches_evidence"),
    (ISSUES["CONS-006"], "CONS-006", "warning", "evidence", "verify_evidence_relevance"),
    (ISSUES["CONS-007"], "CONS-007", "warning", "impact", "align_impact_with_severity"),
    ("true", "CONS-008", "info", "consistency", "review_all_consistency_flags"),
]
_CATEGORY = "CASE split_part(taxonomy_code, '-', 1) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in V.CODE_CATEGORIES.items()) + " ELSE 'completeness' END"
_LONG = f"{BASE}, long AS (" + " UNION ALL ".join(f"SELECT finding_id, {i} AS o, {quoted(code)} AS taxonomy_code, {quoted(sev)} AS severity, {quoted(field)} AS field, {quoted(action)} AS suggested_action FROM judged WHERE {cond}" for i, (cond, code, sev, field, action) in enumerate(_COMMENTS)) + ")"


def _only(prefix: str):
    return [(cond, code) for cond, code, *_ in _COMMENTS if code.startswith(prefix + "-")]


ORACLE_SQL = {
    "review_completeness": f"{BASE} SELECT finding_id, severity IS NOT NULL AND observation <> '' AND n > 0 AS is_complete, {_sql_codes(_COMP)} AS missing_required, {_sql_codes(_COND)} AS missing_conditional FROM judged",
    "review_evidence": f"{BASE} SELECT finding_id, sufficient AS is_sufficient, refuted::BIGINT AS n_unsupported, {_sql_codes(_only('EVID'))} AS codes FROM judged",
    "review_classification": f"{BASE} SELECT finding_id, {LABEL} AS label, {SUPPORTED} AS supported, {_sql_codes(_only('CLASS'))} AS codes FROM judged",
    "severity_review": f"{BASE} SELECT finding_id, severity AS reported, band AS implied, severity = band AS is_consistent, {MISMATCH} AS change_recommended, CASE WHEN {MISMATCH} THEN band END AS suggested FROM judged",
    "review_cvss": f"{BASE} SELECT finding_id, {_VALID} AS vector_valid, coalesce(vector, '') = '' AS manual_recalculation, {_sql_codes(_only('CVSS'))} AS codes FROM judged",
    "review_cwe": f"{BASE} SELECT finding_id, {_CWE_OK} AS format_valid, CASE WHEN {_CWE_OK} THEN {_CWE_HIT} END AS is_relevant, {_sql_codes(_only('CWE'))} AS codes FROM judged",
    "review_impact": f"{BASE} SELECT finding_id, CASE WHEN imp <> '' THEN NOT ({_IMPACT_UNSUPPORTED}) END AS is_supported, CASE WHEN imp <> '' THEN NOT {_MILD} END AS is_proportionate, {_sql_codes(_only('IMP'))} AS codes FROM judged",
    "review_recommendation": f"{BASE} SELECT finding_id, CASE WHEN rec <> '' THEN {_like('rec', V.ACTION_WORDS)} END AS is_actionable, {_ROOT} AS addresses_root_cause, {_sql_codes(_only('REC'))} AS codes FROM judged",
    "review_retest": f"{BASE} SELECT finding_id, CASE {_RETEST} WHEN 'shown' THEN true WHEN 'unshown' THEN false END AS supported, {_sql_codes(_only('RET'))} AS codes FROM judged",
    "review_consistency": f"{BASE}, issues AS (SELECT finding_id, {_sql_codes([(v, k) for k, v in ISSUES.items()])} AS issues FROM judged) SELECT finding_id, NOT (contains(issues, 'CONS-001') OR contains(issues, 'CONS-005') OR contains(issues, 'CONS-006') OR contains(issues, 'CONS-007')) AS is_consistent, issues FROM issues",
    "review_confidence": f"""{SCORED} SELECT finding_id, confidence_score AS score, CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS level,
        concat_ws('; ', CASE WHEN f_evidence >= 0.8 THEN 'Evidence is sufficient and supports the vulnerability claim' WHEN f_evidence >= 0.5 THEN 'Evidence is partial — some gaps exist' ELSE 'Evidence is insufficient to support the claim' END,
            CASE WHEN f_class >= 0.8 THEN 'Classification is well-supported by evidence' WHEN f_class >= 0.5 THEN 'Classification has moderate support' END, CASE WHEN f_cvss >= 0.8 THEN 'CVSS score and reported severity are consistent' END,
            CASE WHEN f_sections >= 0.8 THEN 'All required sections are present and complete' END, CASE WHEN f_retest >= 0.8 THEN 'Retest has been performed' END) AS basis,
        concat_ws('; ', CASE WHEN f_evidence < 0.5 THEN 'Evidence is insufficient or absent' END, CASE WHEN f_class < 0.5 THEN 'Classification is uncertain or contradicted by evidence' END, CASE WHEN f_cvss < 0.8 THEN 'CVSS score and reported severity are inconsistent' END,
            CASE WHEN f_sections < 0.8 THEN 'Some required sections are missing or incomplete' END, CASE WHEN f_retest < 0.8 THEN 'No retest has been performed' END) AS limitations FROM scored""",
    "review_escalation": f"{ESCALATED} SELECT finding_id, reasons <> '' AS required, reasons, CASE WHEN severity IN ('critical', 'high') THEN 'senior_pentester' WHEN {MISMATCH} THEN 'report_reviewer' END AS reviewer FROM escalated",
    "review_status": f"{ESCALATED} SELECT finding_id, {STATUS} AS review_status FROM escalated",
    "review_stats": f"{ESCALATED} SELECT {STATUS} AS review_status, count(*) AS n FROM escalated GROUP BY 1",
    "review_comments": f"""{_LONG} SELECT finding_id, 'RC-' || lpad(CAST(row_number() OVER (PARTITION BY finding_id ORDER BY o) AS VARCHAR), 3, '0') AS comment_id, taxonomy_code, {_CATEGORY} AS category, severity, field, suggested_action, CASE WHEN taxonomy_code = 'EVID-002' THEN
        (SELECT e.evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY i) AS k FROM evidence WHERE {_like("lower(content)", V.NO_EXPLOIT_SIGNALS)}) e WHERE e.finding_id = long.finding_id AND e.k = long.o - 6) END AS evidence_reference FROM long""",
    "review_comment_counts": f"{_LONG} SELECT taxonomy_code, {_CATEGORY} AS category, count(*) AS n FROM long GROUP BY 1, 2",
}
