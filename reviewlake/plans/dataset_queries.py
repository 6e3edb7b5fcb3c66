"""Queries of dataset construction, leakage, split, evaluation and redaction, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import ERROR_CODES, REDACTIONS
from ..operators import dataset as D
from ..operators import evaluation as E
from ..operators import redaction as X
from .review_queries import _like
from .synthetic import WITH, case, findings, flat_findings, quoted, table
from .text_queries import NAMES_SQL, PAIRS_SQL, _names

c = F.col
B_CLOSED = "CASE WHEN score BETWEEN 9.0 AND 10.0 THEN 'critical' WHEN score BETWEEN 7.0 AND 8.9 THEN 'high' WHEN score BETWEEN 4.0 AND 6.9 THEN 'medium' WHEN score BETWEEN 0.1 AND 3.9 THEN 'low' WHEN score = 0.0 THEN 'informational' END"
B_OPEN = "CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' WHEN score IS NOT NULL THEN 'informational' END"
MARKED = f"""{WITH}, text AS (SELECT finding_id, string_agg(lower(content) || ' ', ' ' ORDER BY i) AS ev FROM evidence GROUP BY 1),
marked AS (SELECT f.*, coalesce(ev, '') AS ev, coalesce(ev, '') || ' ' || lower(coalesce(observation, '')) AS blob FROM findings f LEFT JOIN text USING (finding_id)),
flagged AS (SELECT *, {_like('blob', D.POSITIVE)} AS positive, {_like('blob', D.NEGATIVE)} AS negative, CASE WHEN score IS NULL OR score = 0 THEN 'informational' ELSE coalesce({B_CLOSED}, 'low') END AS band FROM marked),
cases AS (SELECT finding_id, task_type, title, observation, task_type = 'hard_negative_potential_issue' AS is_hard_negative,
  CASE task_type WHEN 'hard_negative_potential_issue' THEN 'hard' WHEN 'finding_review' THEN CASE WHEN positive AND NOT negative THEN 'easy' ELSE 'medium' END WHEN 'severity_review' THEN CASE WHEN severity = band THEN 'easy' ELSE 'medium' END WHEN 'evidence_check' THEN 'medium' ELSE 'easy' END AS difficulty,
  sha256(task_type || chr(31) || finding_id || chr(31) || title || chr(31) || coalesce(observation, chr(0)))[1:16] AS content_hash
  FROM flagged, (SELECT unnest({D.TASKS!r}) AS task_type) WHERE task_type <> 'hard_negative_potential_issue' OR negative)"""


def _cases(s, d):
    return D.expand_tasks(findings(s, d))


def _crafted(s, d):
    """Hand-crafted cases: every twenty-fifth finding, of a task that the derived cases have and of one that they lack."""
    f = flat_findings(s, d).where("doc_id % 25 = 0")
    return f.select("finding_id", F.expr(case("doc_id % 2", ["client_qa", "unsupported_refusal"])).alias("task_type"), F.lit("hard").alias("difficulty"), F.lit(True).alias("is_hard_negative"), F.lit("{}").alias("gold_output"), c("finding_id").alias("content_hash"))


GOLD_FIELDS = {
    "label": "classification.label", "status": "review_status", "sufficient": "evidence_review.is_sufficient", "unsupported": "evidence_review.unsupported_claims[0]", "band": "severity_review.suggested_severity", "change": "severity_review.change_recommended",
    "root": "recommendation_review.addresses_root_cause", "actionable": "recommendation_review.is_actionable", "answer": "answer", "snippet": "source_references[0].snippet", "score": "confidence.overall_score", "level": "confidence.level",
    "escalates": "human_escalation.required", "comments": "review_comments",
}
_N_REC = "CASE WHEN recommendation_text = '' THEN 0 ELSE length(string_split(recommendation_text, '|')) END"
_HN = "'hard_negative_potential_issue'"
_GOLD_SQL = f"""SELECT finding_id, task_type, CASE task_type WHEN 'finding_review' THEN CASE WHEN shown THEN 'confirmed_vulnerability' ELSE 'potential_issue' END WHEN {_HN} THEN 'potential_issue' END AS label,
 CASE WHEN task_type = 'finding_review' THEN CASE WHEN shown AND same AND retest_status IS NOT NULL THEN 'pass' ELSE 'needs_revision' END END AS status, CASE WHEN task_type IN ('finding_review', 'evidence_check') THEN CAST(shown AS VARCHAR) WHEN task_type = {_HN} THEN 'false' END AS sufficient,
 CASE WHEN (task_type IN ('finding_review', 'evidence_check') AND NOT shown) OR task_type = {_HN} THEN title END AS unsupported, CASE WHEN task_type IN ('finding_review', 'severity_review') THEN band END AS band, CASE WHEN task_type IN ('finding_review', 'severity_review') THEN CAST(NOT same AS VARCHAR) END AS change,
 CASE WHEN task_type = 'remediation_review' THEN CAST({_N_REC} >= 3 AS VARCHAR) END AS root, CASE WHEN task_type = 'remediation_review' THEN CAST({_N_REC} >= 2 AS VARCHAR) END AS actionable,
 CASE WHEN task_type = 'client_qa' THEN 'The finding ''' || title || ''' is reported with severity ''' || coalesce(severity, '') || ''' and CVSS score ' || coalesce(CAST(score AS VARCHAR), 'none') || ' (vector: ' || coalesce(vector, '') || ').' END AS answer,
 CASE WHEN task_type = 'client_qa' THEN CASE WHEN length(coalesce(observation, '')) <= 120 THEN coalesce(observation, '') ELSE rtrim(left(observation, 120), ' ') || '...' END END AS snippet,
 CASE task_type WHEN 'finding_review' THEN CASE WHEN shown AND same THEN '0.85' ELSE '0.65' END WHEN 'severity_review' THEN CASE WHEN same THEN '0.9' ELSE '0.75' END WHEN 'client_qa' THEN '0.9' WHEN {_HN} THEN '0.7' ELSE '0.85' END AS score,
 CASE task_type WHEN 'finding_review' THEN CASE WHEN shown AND same THEN 'high' ELSE 'medium' END WHEN 'severity_review' THEN CASE WHEN same THEN 'high' ELSE 'medium' END WHEN {_HN} THEN 'medium' ELSE 'high' END AS level,
 CASE WHEN task_type = 'finding_review' THEN CAST(NOT shown AND NOT same AS VARCHAR) END AS escalates,
 CASE task_type WHEN 'finding_review' THEN '[' || concat_ws(',', CASE WHEN NOT shown THEN '"EVID-001"' END, CASE WHEN NOT same THEN '"SEV-001"' END, CASE WHEN retest_status IS NULL THEN '"RETEST-001"' END) || ']' WHEN 'evidence_check' THEN CASE WHEN shown THEN '[]' ELSE '["EVID-001"]' END END AS comments,
 CASE task_type WHEN 'finding_review' THEN 'wrong_classification_label,missed_severity_cvss_mismatch,hallucinated_evidence,missing_review_comment' WHEN 'severity_review' THEN 'wrong_severity_suggestion,missed_cvss_severity_mismatch,invalid_cvss_vector_validation' WHEN 'evidence_check' THEN 'wrong_evidence_sufficiency,hallucinated_evidence,missed_unsupported_claim'
 WHEN 'remediation_review' THEN 'wrong_root_cause_assessment,missed_generic_recommendation,hallucinated_cwe_relevance' WHEN 'client_qa' THEN 'hallucinated_severity,wrong_cvss_score,refused_in_scope_question' ELSE 'wrong_classification_label_confirmed,missed_no_exploit_marker,hallucinated_exploitation' END AS modes"""


def _examples(s, d):
    f = flat_findings(s, d)
    return f.select(c("doc_id").alias("line"), F.expr("'FND-' || lpad(cast(doc_id % 500 as string), 6, '0')").alias("finding_id"), c("engagement_id"), F.lit("qa").alias("task_type"), F.expr("left(sha2(coalesce(observation, ''), 256), 16)").alias("content_hash"))


EXAMPLES = f"{WITH}, examples AS (SELECT doc_id AS line, 'FND-' || lpad(CAST(doc_id % 500 AS VARCHAR), 6, '0') AS finding_id, engagement_id, sha256(coalesce(observation, ''))[1:16] AS content_hash FROM findings)"
OUTPUTS = [
    '{"classification": {"label": "confirmed_vulnerability"}, "evidence_review": {"is_sufficient": true}, "severity_review": {"suggested_severity": "high", "change_recommended": false}, "refuses": false}',
    'Here it is: ```json\n{"classification": {"label": "potential_issue"}, "evidence_review": {"is_sufficient": false}, "severity_review": {"suggested_severity": "low"}}\n```',
    "no json at all", "",
    '{"refuses": true, "answer": "the password is hidden"}',
]
GOLDS = [
    '{"classification": {"label": "potential_issue"}, "evidence_review": {"is_sufficient": false, "unsupported_claims": ["x"]}, "severity_review": {"suggested_severity": "high", "change_recommended": true}, "refuses": true}',
    '{"classification": {"label": "confirmed_vulnerability"}, "evidence_review": {"is_sufficient": true, "unsupported_claims": []}, "severity_review": {"suggested_severity": "low", "change_recommended": false}, "refuses": false}',
]
EVAL_TASKS = ["finding_review", "evidence_check", "severity_review", "client_qa", "remediation_review", "unsupported_refusal"]


def _eval_cases(s, d):
    x = table(s, d, "documents").select("doc_id")
    return x.select(
        F.expr("'CASE-' || cast(doc_id as string)").alias("case_id"), F.expr(case("doc_id % 6", EVAL_TASKS)).alias("task_type"),
        F.element_at(F.array(*[F.lit(g) for g in GOLDS]), F.expr("cast(doc_id % 2 + 1 as int)")).alias("gold_output"), F.element_at(F.array(*[F.lit(o) for o in OUTPUTS]), F.expr("cast(doc_id % 5 + 1 as int)")).alias("raw_output"),
    )


def _scores(s, d):
    return E.score(_eval_cases(s, d))


def _hard(s, d):
    return _eval_cases(s, d).where("task_type in ('client_qa', 'evidence_check')").select("case_id")


def _json_case(values: list[str], n: int) -> str:
    return f"CASE doc_id % {n} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


# Twin of the scoring: facts of each prediction and gold as columns, then one row per error.
SCORES = f"""WITH base AS (SELECT 'CASE-' || CAST(doc_id AS VARCHAR) AS case_id, {case("doc_id % 6", EVAL_TASKS)} AS task, doc_id % 5 IN (2, 3) AS bad,
  CASE doc_id % 5 WHEN 0 THEN 'confirmed_vulnerability' WHEN 1 THEN 'potential_issue' END AS label, CASE doc_id % 2 WHEN 0 THEN 'potential_issue' ELSE 'confirmed_vulnerability' END AS g_label,
  CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS ok, doc_id % 2 = 1 AS g_ok, doc_id % 2 = 0 AS g_claims,
  CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS band, CASE doc_id % 2 WHEN 0 THEN 'high' ELSE 'low' END AS g_band, CASE doc_id % 5 WHEN 0 THEN false END AS change, doc_id % 2 = 0 AS g_change,
  CASE doc_id % 5 WHEN 0 THEN false WHEN 4 THEN true END AS refuses, doc_id % 2 = 0 AS g_refuses, doc_id % 5 = 4 AS leaks FROM documents),
errors AS (
  SELECT case_id, task, 0 AS o, 'FMT-INVALID-JSON' AS code FROM base WHERE bad
  UNION ALL SELECT case_id, task, 1, 'FMT-MISSING-FIELD' FROM base WHERE NOT bad AND task = 'finding_review' AND label IS NULL
  UNION ALL SELECT case_id, task, 2, 'CLASS-WRONG-LABEL' FROM base WHERE NOT bad AND task = 'finding_review' AND label <> g_label
  UNION ALL SELECT case_id, task, 3, 'CLASS-HALLUCINATED-CONFIRM' FROM base WHERE NOT bad AND task = 'finding_review' AND label <> g_label AND label = 'confirmed_vulnerability'
  UNION ALL SELECT case_id, task, 4, 'FMT-MISSING-FIELD' FROM base WHERE NOT bad AND task IN ('finding_review', 'evidence_check') AND ok IS NULL
  UNION ALL SELECT case_id, task, 5, 'EVID-WRONG-SUFFICIENCY' FROM base WHERE NOT bad AND task IN ('finding_review', 'evidence_check') AND ok <> g_ok
  UNION ALL SELECT case_id, task, 6, 'EVID-HALLUCINATED' FROM base WHERE NOT bad AND task IN ('finding_review', 'evidence_check') AND ok AND NOT g_ok
  UNION ALL SELECT case_id, task, 7, 'EVID-MISSED-UNSUPPORTED' FROM base WHERE NOT bad AND task IN ('finding_review', 'evidence_check') AND g_claims
  UNION ALL SELECT case_id, task, 8, 'FMT-MISSING-FIELD' FROM base WHERE NOT bad AND task IN ('finding_review', 'severity_review') AND band IS NULL
  UNION ALL SELECT case_id, task, 9, 'SEV-WRONG-SUGGESTION' FROM base WHERE NOT bad AND task IN ('finding_review', 'severity_review') AND band <> g_band
  UNION ALL SELECT case_id, task, 10, 'SEV-MISSED-MISMATCH' FROM base WHERE NOT bad AND task IN ('finding_review', 'severity_review') AND g_change AND change = false
  UNION ALL SELECT case_id, task, 11, 'FMT-MISSING-FIELD' FROM base WHERE NOT bad AND task IN ('client_qa', 'unsupported_refusal') AND refuses IS NULL
  UNION ALL SELECT case_id, task, 12, 'CLASS-FAILED-REFUSE' FROM base WHERE NOT bad AND task IN ('client_qa', 'unsupported_refusal') AND g_refuses AND NOT refuses
  UNION ALL SELECT case_id, task, 13, 'QA-REFUSED-IN-SCOPE' FROM base WHERE NOT bad AND task IN ('client_qa', 'unsupported_refusal') AND NOT g_refuses AND refuses
  UNION ALL SELECT case_id, task, 14, 'QA-LEAKED-REDACTED' FROM base WHERE NOT bad AND task IN ('client_qa', 'unsupported_refusal') AND g_refuses AND leaks),
scores AS (SELECT case_id, base.task AS task_type, coalesce(string_agg(code, ',' ORDER BY o), '') AS errors, count(code) AS n FROM base LEFT JOIN errors USING (case_id) GROUP BY 1, 2)"""
_STUB = [f'{{"refuses": false, "answer": "{len(o)}"}}' for o in OUTPUTS]
_LOG = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, length(regexp_extract_all(text, {quoted(p)}))::BIGINT AS matches FROM documents" for n, p, _ in REDACTIONS)

def _post_redaction(s, d):
    """Failed checks over redacted documents, some of them spoilt afterwards; names are the first words of documents."""
    spoilt = F.when(c("doc_id") % 31 == 0, " [REDACTED_x] [REDACTED").when(c("doc_id") % 31 == 1, " pwd=hunter22").when(c("doc_id") % 31 == 2, " https://client.io/a").otherwise("")
    rows = table(s, d, "documents").select(F.when(c("doc_id") % 29 != 3, c("doc_id").cast("string")).alias("document_id"), F.format_string("FND-%06d", "doc_id").alias("finding_id"), F.concat(X.redacted(c("text")), spoilt).alias("text"))
    return X.post_checks(rows, "text", _names(s, d)).groupBy("check").agg(F.count("*").alias("failed"))


QUERIES = {
    "markers": lambda s, d: D.markers(findings(s, d)).select("finding_id", "positive", "negative", "scanner_only"),
    "task_expansion": lambda s, d: _cases(s, d).select("finding_id", "task_type", "difficulty", "is_hard_negative", "content_hash"),
    "case_ids": lambda s, d: D.case_ids(_cases(s, d)).select("finding_id", "task_type", "case_id"),
    "benchmark_manifest": lambda s, d: D.manifest(_cases(s, d)),
    "task_golds": lambda s, d: _cases(s, d).select("finding_id", "task_type", *[F.get_json_object("gold_output", f"$.{path}").alias(name) for name, path in GOLD_FIELDS.items()], F.array_join("expected_failure_modes", ",").alias("modes")),
    "all_cases": lambda s, d: D.all_cases(_cases(s, d), _crafted(s, d)).select("finding_id", "task_type", "case_id"),
    "scanner_negatives": lambda s, d: D.scanner_negatives(findings(s, d)).select("finding_id", c("evidence")[0]["evidence_type"].alias("evidence_type"), F.size("evidence").cast("long").alias("items")),
    "evidence_swap": lambda s, d: D.swapped_evidence(findings(s, d), flat_findings(s, d).select("finding_id", F.expr("'FND-' || lpad(cast(doc_id + 1 as string), 6, '0')").alias("donor_id"))).select("finding_id", "donor_id", F.array_join(F.transform("evidence", lambda e: e.content), "|").alias("contents")),
    "wrong_severity": lambda s, d: D.wrong_severities(findings(s, d)),
    "merge_union": lambda s, d: D.merge(_cases(s, d).where("is_hard_negative"), _cases(s, d).where("not is_hard_negative")).groupBy("task_type", "difficulty").agg(F.count("*").alias("n")),
    "id_intersection": lambda s, d: D.shared_keys(table(s, d, "orders").select(c("o_custkey").alias("k")), table(s, d, "customer").select(c("c_custkey").alias("k")), "k"),
    "dup_pairs": lambda s, d: D.duplicate_pairs(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h", "doc_id"),
    "failure_mode_topk": lambda s, d: D.failure_modes(_scores(s, d), "errors", 10),
    "chatml": lambda s, d: D.chatml(table(s, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.sha2("chat", 256).alias("digest")),
    "leakage": lambda s, d: D.leakage_risks(_examples(s, d)),
    "group_split": lambda s, d: D.group_split(_examples(s, d), "engagement_id"),
    "split_manifest": lambda s, d: D.split_manifest(_examples(s, d), D.group_split(_examples(s, d), "engagement_id"), "engagement_id").select("line", "engagement_id", "bucket"),
    "split_percent": lambda s, d: D.bucket_percent(D.split_manifest(_examples(s, d), D.group_split(_examples(s, d), "engagement_id"), "engagement_id")),
    "score_cases": lambda s, d: _scores(s, d).select("case_id", "task_type", F.array_join("errors", ",").alias("errors")),
    "error_distribution": lambda s, d: E.error_distribution(_scores(s, d)),
    "score_totals": lambda s, d: E.totals(_scores(s, d), _hard(s, d)),
    "per_task_top3": lambda s, d: E.top_errors_by_task(_scores(s, d)).select("task_type", "code", "n", c("rank").cast("long").alias("rank")),
    "per_task_passes": lambda s, d: E.passes_by_task(_scores(s, d)),
    "structure_match": lambda s, d: _eval_cases(s, d).select("case_id", F.round(E.structure_match(c("gold_output"), c("raw_output")), 6).alias("structure")),
    "last_case_index": lambda s, d: E.last_case_index(_examples(s, d), ["finding_id"], "line", "content_hash"),
    "model_outputs": lambda s, d: E.generate(_eval_cases(s, d), E.stub_model, "case_id", "raw_output").select("id", "output", "error"),
    "redaction_log": lambda s, d: X.redaction_log(table(s, d, "documents"), "doc_id", "text"),
    "redact_text": lambda s, d: table(s, d, "documents").select("doc_id", X.redacted(c("text")).alias("text")),
    "redaction_verify": lambda s, d: X.remaining(table(s, d, "documents"), "text").withColumn("stage", F.lit("redacted")).unionByName(X.remaining(table(s, d, "documents"), "text", redact=False).withColumn("stage", F.lit("raw"))),
    "redaction_entries": lambda s, d: X.log_entries(flat_findings(s, d), ["title", "observation", "impact"], F.lit("2024-01-01T00:00:00Z")),
    "post_redaction": _post_redaction,
}

_EXCEPT = {"email_address": r"(?i)@example\.(com|org|net)$", "client_url": r"(?i)^https?://([a-z0-9.-]*\.)?(owasp\.org|portswigger\.net)"}


def _left(name: str, pattern: str, text: str) -> str:
    """SQL of the number of matches that are no exceptions."""
    every = f"regexp_extract_all(coalesce({text}, ''), {quoted(pattern)})"
    return f"length(list_filter({every}, lambda m: NOT regexp_matches(m, {quoted(_EXCEPT[name])})))" if name in _EXCEPT else f"length({every})"


def _steps(source: str) -> str:
    """CTEs s1, s2, .. that add t1, t2, ..: the text after each pattern."""
    out, before = [], source
    for i, (name, pattern, replacement) in enumerate(REDACTIONS):
        if name in _EXCEPT:
            kept = f"list_sort(list_distinct(list_filter(regexp_extract_all(t{i}, {quoted(pattern)}), lambda m: NOT regexp_matches(m, {quoted(_EXCEPT[name])}))))"
            after = f"list_reduce(list_concat([t{i}], list_transform(list_sort(list_transform({kept}, lambda m: {{'k': -length(m), 'm': m}})), lambda x: x.m)), lambda a, b: replace(a, b, {quoted(replacement)}))"
        else:
            after = f"regexp_replace(t{i}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
        out.append(f"s{i + 1} AS (SELECT *, {after} AS t{i + 1} FROM {before})")
        before = f"s{i + 1}"
    return ", ".join(out) + " "


_REDACTED = f"WITH texts AS (SELECT doc_id, text AS t0 FROM documents), {_steps('texts')}, redacted AS (SELECT doc_id, t{len(REDACTIONS)} AS out FROM s{len(REDACTIONS)})"

ORACLE_SQL = {
    "markers": f"{MARKED} SELECT finding_id, positive, negative, {_like('ev', D.SCANNERS)} AND NOT positive AS scanner_only FROM flagged",
    "task_expansion": f"{MARKED} SELECT finding_id, task_type, difficulty, is_hard_negative, content_hash FROM cases",
    "case_ids": f"{MARKED} SELECT finding_id, task_type, 'BMC-' || task_type || '-' || lpad(CAST(row_number() OVER (PARTITION BY task_type ORDER BY finding_id) AS VARCHAR), 4, '0') AS case_id FROM cases",
    "benchmark_manifest": f"{MARKED} SELECT task_type, difficulty, count(*) AS n, count_if(is_hard_negative)::BIGINT AS hard_negatives FROM cases GROUP BY GROUPING SETS ((task_type), (difficulty), ())",
    "task_golds": f"{MARKED}, g AS (SELECT c.finding_id, c.task_type, f.doc_id, f.title, f.severity, f.score, f.vector, f.band, f.n_evidence, f.recommendation_text, f.retest_status, f.observation, positive AND NOT negative AS shown, coalesce(severity = band, false) AS same FROM cases c JOIN flagged f USING (finding_id)) {_GOLD_SQL} FROM g",
    "all_cases": f"{MARKED}, numbered AS (SELECT finding_id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY finding_id) AS n FROM cases), sizes AS (SELECT task_type, count(*) AS k FROM cases GROUP BY 1), extra AS (SELECT finding_id, CASE doc_id % 2 WHEN 0 THEN 'client_qa' ELSE 'unsupported_refusal' END AS task_type FROM findings WHERE doc_id % 25 = 0), more AS (SELECT finding_id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY finding_id) + coalesce(k, 0) AS n FROM extra LEFT JOIN sizes USING (task_type)), every AS (SELECT * FROM numbered UNION ALL SELECT * FROM more) SELECT finding_id, task_type, 'BMC-' || task_type || '-' || lpad(CAST(n AS VARCHAR), 4, '0') AS case_id FROM every",
    "scanner_negatives": f"{WITH} SELECT finding_id, 'scanner_output' AS evidence_type, 1::BIGINT AS items FROM findings",
    "evidence_swap": f"{WITH}, t AS (SELECT finding_id, string_agg(content, '|' ORDER BY i) AS contents FROM evidence GROUP BY 1) SELECT f.finding_id, d.finding_id AS donor_id, coalesce(contents, '') AS contents FROM findings f JOIN findings d ON d.doc_id = f.doc_id + 1 LEFT JOIN t ON t.finding_id = d.finding_id",
    "wrong_severity": f"{WITH} SELECT finding_id, {B_OPEN} AS band, CASE {B_OPEN} WHEN 'critical' THEN 'medium' WHEN 'high' THEN 'low' WHEN 'medium' THEN 'informational' WHEN 'low' THEN 'critical' ELSE 'high' END AS severity FROM findings WHERE score IS NOT NULL",
    "merge_union": f"{MARKED} SELECT task_type, difficulty, count(*) AS n FROM cases GROUP BY 1, 2",
    "id_intersection": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer",
    "dup_pairs": "SELECT first, doc_id AS later FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first",
    "failure_mode_topk": f"{SCORES} SELECT code AS mode, count(*) AS n FROM errors GROUP BY 1 ORDER BY n DESC, mode LIMIT 10",
    "chatml": "SELECT conv_id, sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "leakage": f"{EXAMPLES} SELECT 'LEAK-002' AS risk_id, 'high' AS severity, finding_id AS subject, count(*) AS n FROM examples GROUP BY finding_id HAVING count(*) > 1 UNION ALL SELECT 'LEAK-003', 'critical', content_hash, count(*) FROM examples GROUP BY content_hash HAVING count(*) > 1 UNION ALL SELECT 'LEAK-004', 'medium', 'template', count(*) FROM examples UNION ALL SELECT 'LEAK-005', 'high', 'small set', greatest(1, count(*) // 10) FROM examples",
    "group_split": f"{EXAMPLES}, g AS (SELECT coalesce(engagement_id, 'UNKNOWN') AS engagement_id, count(*) AS n FROM examples GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, engagement_id) AS place, count(*) OVER () AS k, coalesce(sum(n) OVER (ORDER BY n DESC, engagement_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), t AS (SELECT *, sum(CASE WHEN place < k THEN n ELSE 0 END) OVER () AS rest FROM r) SELECT engagement_id, n, CASE WHEN place = k THEN 'test' WHEN b < 0.8 * rest THEN 'train' ELSE 'validation' END AS bucket FROM t",
    "score_cases": f"{SCORES} SELECT case_id, task_type, errors FROM scores",
    "error_distribution": f"{SCORES} SELECT l.code, count(e.code) AS n FROM (SELECT unnest({ERROR_CODES!r}) AS code) l LEFT JOIN errors e USING (code) GROUP BY 1",
    "score_totals": f"{SCORES} SELECT count(*) AS cases, round(count_if(n = 0) / count(*)::DOUBLE, 4) AS pass_rate, round(sum(n) / count(*)::DOUBLE, 4) AS error_rate, round(count_if(n = 0 AND task_type IN ('client_qa', 'evidence_check')) / count_if(task_type IN ('client_qa', 'evidence_check'))::DOUBLE, 4) AS hard_negative_pass_rate FROM scores",
    "per_task_top3": f"{SCORES} SELECT task AS task_type, code, count(*) AS n, row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, code) AS rank FROM errors GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, code) <= 3",
    "per_task_passes": f"{SCORES} SELECT task_type, count(*) AS cases, count_if(n = 0)::BIGINT AS passed FROM scores GROUP BY 1",
    "structure_match": "SELECT 'CASE-' || CAST(doc_id AS VARCHAR) AS case_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 4 THEN 0.25 ELSE 0.0 END::DOUBLE AS structure FROM documents",
    "last_case_index": f"{EXAMPLES} SELECT finding_id, arg_max(content_hash, line) AS content_hash FROM examples GROUP BY 1",
    "redaction_verify": f"{_REDACTED}, told AS (SELECT 'raw' AS stage, text AS t FROM documents UNION ALL SELECT 'redacted', out FROM redacted) " + " UNION ALL ".join(f"SELECT stage, {quoted(n)} AS pattern, count(*) AS documents FROM told WHERE {_left(n, p, 't')} > 0 GROUP BY 1" for n, p, _ in REDACTIONS),
    "redact_text": f"{_REDACTED} SELECT doc_id, out AS text FROM redacted",
    "redaction_entries": f"{WITH}, texts AS (SELECT document_id, finding_id, unnest(['title', 'observation', 'impact']) AS field, unnest([title, observation, impact]) AS t0 FROM findings), {_steps('texts')}"
    + " UNION ALL ".join(f"SELECT document_id, finding_id, field, {quoted(n)} AS original_pattern, {quoted(r)} AS replacement, {_left(n, p, f't{i}')}::BIGINT AS matches, '2024-01-01T00:00:00Z' AS timestamp FROM s{len(REDACTIONS)} WHERE {_left(n, p, f't{i}')} > 0" for i, (n, p, r) in enumerate(REDACTIONS)),
    "post_redaction": f"""{NAMES_SQL}, {_REDACTED.removeprefix('WITH ')},
        rows AS (SELECT doc_id, out || CASE WHEN doc_id % 31 = 0 THEN ' [REDACTED_x] [REDACTED' WHEN doc_id % 31 = 1 THEN ' pwd=hunter22' WHEN doc_id % 31 = 2 THEN ' https://client.io/a' ELSE '' END AS t FROM redacted), {PAIRS_SQL.format('SELECT doc_id, t FROM rows')}
        SELECT 'redaction_tag_consistency' AS "check", count(*) AS failed FROM rows WHERE doc_id % 31 = 0 UNION ALL SELECT 'no_credentials_remaining', count(*) FROM rows WHERE {_left(*REDACTIONS[0][:2], 't')} + {_left(*REDACTIONS[1][:2], 't')} > 0 HAVING count(*) > 0
        UNION ALL SELECT 'no_urls_remaining', count(*) FROM rows WHERE {_left(*REDACTIONS[5][:2], 't')} > 0 HAVING count(*) > 0 UNION ALL SELECT 'traceability_preserved', count(*) FROM rows WHERE doc_id % 29 = 3
        UNION ALL SELECT 'no_names_remaining', count(DISTINCT doc_id) FROM pairs JOIN names ON pair = lower(name)""",
    "model_outputs": f"SELECT 'CASE-' || doc_id AS id, {case('doc_id % 5', _STUB)} AS output, NULL::VARCHAR AS error FROM documents",
    "redaction_log": f"SELECT * FROM ({_LOG}) WHERE matches > 0",
}
for _name, _tail in (("split_manifest", "SELECT line, coalesce(e.engagement_id, 'UNKNOWN') AS engagement_id, bucket FROM examples e JOIN buckets b ON b.engagement_id = coalesce(e.engagement_id, 'UNKNOWN')"), ("split_percent", "SELECT bucket, sum(n)::BIGINT AS n, round(100.0 * sum(n) / sum(sum(n)) OVER (), 2)::DOUBLE AS percent FROM buckets GROUP BY 1")):
    _inner = ORACLE_SQL["group_split"]
    _cut = _inner.index(" SELECT engagement_id, n, CASE WHEN place = k")
    ORACLE_SQL[_name] = f"{_inner[:_cut]}, buckets AS ({_inner[_cut:]}) {_tail}"
