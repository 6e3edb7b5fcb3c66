"""Queries of output records, catalogue migration, retrieval filters, dataset parts, comparisons and contextual redaction.

Their twins state the results from the rows' keys, by hand; they import no rule of an operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dataset as D
from ..operators import evaluation as E
from ..operators import migration as M
from ..operators import redaction as X
from ..operators import normalization as N_
from ..operators import quality, validation
from ..operators import retrieval as N
from ..operators.dataset import POSITIVE, SCANNERS
from ..operators.review import gated_records, output_record, record_json, record_outcome, review, settled
from ..sources import files
from .dataset_queries import EXAMPLES, MARKED, _cases, _eval_cases, _examples
from .finding_queries import DOCS, _raw
from .review_queries import _COMMENTS, _LONG, _RETEST, _ROOT, ESCALATED, ISSUES, LABEL, STATUS, _like, _sql_codes
from .synthetic import WITH, case, findings, flat_findings, quoted, table
from .table_queries import KB_SQL, QC_SQL, WS, _kb

c = F.col

# ---------------------------------------------------------------- output record


def _records(s, d):
    return output_record(review(findings(s, d)), F.lit("2024-01-01T00:00:00+00:00"), {"knowledge_base_version": "1.1", "ruleset_version": "1.0"})


def _record(s, d):
    out = _records(s, d)
    return out.select(
        "schema_version", "finding_id", "review_status", "severity_review.suggested_severity", "severity_review.reported_severity", "cvss_review.severity_matches_score", F.size("completeness_review.comments").cast("long").alias("n_completeness"),
        F.array_join("review_comments.taxonomy_code", ",").alias("codes"), F.array_join(F.array_sort(F.array_distinct("review_comments.severity")), ",").alias("kinds"), "confidence.overall_score", "human_escalation.recommended_reviewer",
        F.array_join("consistency_review.issues", ",").alias("issues"), "traceability.source_document_id", "traceability.ruleset_version", "traceability.reviewed_at", F.lit(len(out.columns)).cast("long").alias("n_fields"),
        F.array_join("evidence_review.evidence_items_reviewed", ",").alias("reviewed"), F.size("evidence_review.supported_claims").cast("long").alias("n_supported"), F.array_join("recommendation_review.missing_recommendations", "; ").alias("advice"),
        F.array_join("retest_review.missing_retest_evidence", "; ").alias("unproven"), F.size("impact_review.unsupported_impact_claims").cast("long").alias("n_impact_claims"), "retest_review.reported_status",
    )


def _record_faults(s, d):
    """Records against the whole output schema; beside ours, which have no fault, the same records spoiled in one place by their id."""
    records = _records(s, d)
    out = settled(records.select("finding_id", record_json(records).alias("raw")))
    n = F.substring("finding_id", 5, 6).cast("long")
    spoilt = F.when(n % 5 == 1, F.replace("raw", F.lit('"reviewed_at":"2024-01-01T00'), F.lit('"reviewed_at":"2024-02-30T00'))).when(n % 5 == 2, F.replace("raw", F.lit('"suggested_action":"review_all_consistency_flags"'), F.lit('"suggested_action":""')))
    spoilt = spoilt.when(n % 5 == 3, F.replace("raw", F.lit('"change_recommended":'), F.lit('"changed":'))).when(n % 5 == 4, F.replace("raw", F.lit('"level":"'), F.lit('"level":"very ')))
    both = F.array(F.struct("finding_id", "raw"), F.struct(F.concat("finding_id", F.lit("-spoilt")).alias("finding_id"), spoilt.alias("raw")))
    ours = out.select(F.explode(both).alias("x")).select("x.finding_id", "x.raw").where("raw is not null")
    return validation.errors(ours, "finding_id", "raw", validation.REVIEW_SCHEMA)


def _gated(s, d):
    """Every fifth finding is held back by its gate, every seventh is not known to it."""
    f = findings(s, d)
    n = c("doc_id")
    gate = f.where(n % 7 != 6).select("finding_id", (n % 5 != 4).alias("is_valid"), F.when(n % 5 == 4, F.concat(F.lit("severity "), F.coalesce("severity", F.lit("missing")))).alias("issues"))
    return gated_records(f, gate, F.lit("2024-01-01T00:00:00+00:00"), {"knowledge_base_version": "1.1", "ruleset_version": "1.0"})


def _gated_faults(s, d):
    """(kind, value, n): outcomes of the records, and whatever breaks the output schema."""
    records = _gated(s, d)
    judged = validation.checked(records.select(record_outcome().alias("outcome"), record_json(records).alias("raw")), "raw", validation.REVIEW_SCHEMA)
    told = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    values = F.concat(F.array(told("outcome", c("outcome"))), F.transform("faults", lambda x: told("fault", x.message)))
    return judged.select(F.explode(values).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def _spelled(code: str) -> str:
    group, number = code.split("-")
    return {"IMP": "IMPACT", "REC": "REMD", "RET": "RETEST"}.get(group, group) + "-" + number


_LISTED = [(cond.replace("judged.finding_id", "escalated.finding_id"), _spelled(code), "suggestion" if sev == "info" else sev) for cond, code, sev, *_ in _COMMENTS]
_PASSES = "(doc_id % 7 <> 6 AND doc_id % 5 <> 4)"
_COMPLETE = "(" + " + ".join(f"CASE WHEN {cond} THEN 1 ELSE 0 END" for cond, code, _ in _LISTED if code.startswith("COMP-")) + ")"

# ---------------------------------------------------------------- migration

SOURCES = ["policies/review_taxonomy.yaml, input_schema.json", "docs/problem_definition.md", "EVVO SOP 3", "MITRE CWE list", "evvo sop", None, "schemas/output_schema.json", "CVSS v3.1 guide"]
CATEGORIES = ["sop", "taxonomy_definitions", "severity_guidance"]
SUBCATEGORIES = ["pipeline_step", "escalation", None, ""]
VULN_TITLES = ["Hard-Coded key", "JWT accepts HS256", "Root Detection missing", "Weak SSL pinning", "Username enumeration", "Stored XSS", "SQL Injection in search", "CSRF on form", "Privilege misuse", "Authentication gap", "Info disclosure", "Business logic flaw", "Slow page", None]
VULN_TAGS = [[], ["Crypto"], ["CREDENTIAL", "x"], None]


def _entries(s, d):
    return table(s, d, "documents").select(
        "doc_id", F.expr(case("doc_id % 8", SOURCES)).alias("source"), F.expr(case("doc_id % 3", CATEGORIES)).alias("category"), F.expr(case("doc_id % 4", SUBCATEGORIES)).alias("subcategory"), F.expr(case("doc_id % 14", VULN_TITLES)).alias("title"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('Crypto') WHEN 2 THEN array('CREDENTIAL', 'x') END").alias("tags"),
    )


# ---------------------------------------------------------------- retrieval


def _kb_entries(s, d):
    return table(s, d, "part").select(
        F.expr("concat('KB-', p_partkey)").alias("kb_id"), F.expr(case("p_partkey % 4", ["severity_guidance", "evidence_standards", "escalation_rules", "consistency_rules"])).alias("category"),
        F.expr(case("p_partkey % 3", ["critical", "warning", "info"])).alias("severity"),
        F.expr("CASE p_partkey % 5 WHEN 0 THEN array('all') WHEN 1 THEN array('api') WHEN 2 THEN array('web_application', 'api') ELSE array('android_application') END").alias("applicable_to"),
        F.expr("array(concat('t', p_partkey % 7), concat('s', p_size % 3))").alias("tags"), c("p_name").alias("title"), F.expr("CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END").alias("description"),
        F.expr("CASE WHEN p_partkey % 4 = 1 THEN cast(array() AS array<string>) ELSE array('c1', concat('c', p_size)) END").alias("conditions"), F.expr("CASE WHEN p_partkey % 5 = 3 THEN '' ELSE concat('do ', p_brand) END").alias("action"),
        F.expr(case("p_partkey % 2", ["policy_document", "evvo_rule"])).alias("document_type"),
    )


def _kb_queries(s, d):
    return table(s, d, "nation").select(
        F.expr("concat('Q', n_nationkey)").alias("query_id"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN array('SEV', 'EVID') WHEN 1 THEN array('XXX') END").alias("taxonomy_codes"), F.expr(case("n_nationkey % 4", ["all", "api", None, "web_application"])).alias("domain"),
        F.expr("CASE WHEN n_nationkey % 5 = 0 THEN array('t1', 's2') END").alias("tags"), F.expr("CASE WHEN n_nationkey % 6 = 5 THEN array('escalation_rules') END").alias("categories"), F.expr("CASE WHEN n_nationkey % 7 = 1 THEN 'warning' END").alias("min_severity"),
        F.expr("CASE WHEN n_nationkey % 8 = 2 THEN 'policy_document' END").alias("document_type"),
    )


def _hits(s, d):
    return N.retrieve(_kb_entries(s, d), _kb_queries(s, d), 10)


KB_ROWS = """kb AS (SELECT 'KB-' || p_partkey AS kb_id, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'severity_guidance' WHEN 1 THEN 'evidence_standards' WHEN 2 THEN 'escalation_rules' ELSE 'consistency_rules' END AS category,
 CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, p_partkey % 5 AS target, p_partkey % 7 = 1 OR p_size % 3 = 2 AS tagged, p_partkey % 2 = 0 AS policy,
 p_name AS title, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS description, CASE WHEN p_partkey % 4 <> 1 THEN 'c1; c' || p_size END AS conditions, CASE WHEN p_partkey % 5 <> 3 THEN 'do ' || p_brand END AS action FROM part)"""
HITS = f"""WITH {KB_ROWS}, hits AS (SELECT 'Q' || n_nationkey AS query_id, kb.*, row_number() OVER (PARTITION BY n_nationkey ORDER BY weight DESC, kb_id) AS rank FROM nation, kb
 WHERE (n_nationkey % 3 <> 0 OR category IN ('severity_guidance', 'evidence_standards')) AND (n_nationkey % 4 IN (0, 2) OR target IN (0, 2) OR (n_nationkey % 4 = 1 AND target = 1)) AND (n_nationkey % 5 <> 0 OR tagged)
 AND (n_nationkey % 6 <> 5 OR category = 'escalation_rules') AND (n_nationkey % 7 <> 1 OR weight >= 2) AND (n_nationkey % 8 <> 2 OR policy) QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY weight DESC, kb_id) <= 10)"""


def _methods(s, d):
    every = N.retrieval_metrics(_kb(s, d), N.gold_queries(s)).withColumn("method", F.lit("metadata"))
    first = N.retrieval_metrics(_kb(s, d).where("rank <= 3"), N.gold_queries(s)).withColumn("method", F.lit("first_three"))
    return N.method_summary(every.unionByName(first), "method")


def _typed_entries(s, d):
    """Entries as JSON with absent, null and given fields."""
    raw = F.concat(
        F.lit('{"kb_id": "KB-'), c("doc_id").cast("string"), F.lit('", "category": "sop"'), F.expr(case("doc_id % 3", ["", ', "title": "T"', ', "title": null'])), F.expr(case("doc_id % 2", ["", ', "severity": "critical"'])),
        F.when(c("doc_id") % 5 == 0, ', "applicable_to": ["api", "x"]').otherwise(""), F.lit("}"),
    )
    typed = table(s, d, "documents").select(F.try_parse_json(raw).alias("entry")).select(*files.entry_fields("entry"))
    return typed.select("kb_id", "title", "severity", F.array_join("applicable_to", ",").alias("targets"), F.array_join("conditions", ",").alias("conditions"), "version", "vulnerability_type", F.lit(len(typed.columns)).cast("long").alias("fields"))


# ---------------------------------------------------------------- dataset and evaluation


def _compared(s, d):
    cases = _eval_cases(s, d)
    same = F.concat(F.lit("```json\n"), c("gold_output"), F.lit("\n```"))
    return E.compared(cases.withColumn("raw_output", F.when(F.expr("cast(substring(case_id, 6) as bigint) % 7 = 0"), same).otherwise(c("raw_output"))))


COMPARED = f"""WITH x AS (SELECT 'CASE-' || doc_id AS case_id, {case("doc_id % 6", ["finding_review", "evidence_check", "severity_review", "client_qa", "remediation_review", "unsupported_refusal"])} AS task_type,
  doc_id % 7 = 0 AS same, doc_id % 5 AS o, doc_id % 2 AS g FROM documents),
r AS (SELECT case_id, task_type, same OR o IN (0, 4) AS json_valid, same AS exact_match, CASE WHEN same OR o = 0 THEN 1.0 WHEN o = 4 THEN 0.25 ELSE 0.0 END::DOUBLE AS structure,
  CASE WHEN same THEN 3 WHEN o = 0 AND g = 1 THEN 2 ELSE 0 END::BIGINT AS matched, CASE WHEN same OR o IN (0, 4) THEN 3 ELSE 0 END::BIGINT AS compared,
  CASE WHEN same THEN true WHEN o = 0 THEN g = 1 WHEN o = 4 THEN false END AS classification_match,
  CASE WHEN same THEN 'PASS' WHEN o = 0 THEN 'PARTIAL' WHEN o = 4 THEN 'MISMATCH' ELSE 'FAIL' END AS tier FROM x)"""
MODES = [["hallucinated_answer", "failed_to_refuse"], ["missing_review_comment"], [], ["hallucinated_exploitation", "no_such_mode"]]
_MODE_CODES = "(0, 'hallucinated_answer', 'CLASS-FAILED-REFUSE'), (0, 'hallucinated_answer', 'QA-LEAKED-REDACTED'), (0, 'failed_to_refuse', 'CLASS-FAILED-REFUSE'), (1, 'missing_review_comment', NULL), (3, 'hallucinated_exploitation', 'EVID-HALLUCINATED'), (3, 'hallucinated_exploitation', 'CLASS-HALLUCINATED-CONFIRM'), (3, 'no_such_mode', NULL)"


def _modes(s, d):
    arrays = F.array(*[F.array(*[F.lit(x) for x in m]) if m else F.array().cast("array<string>") for m in MODES])
    return table(s, d, "documents").select("doc_id", F.element_at(arrays, F.expr("cast(doc_id % 4 as int) + 1")).alias("modes"))


def _questions(s, d):
    return flat_findings(s, d).select("finding_id", F.lit("Which version was used?").alias("question"), F.lit("no version is told").alias("refusal_reason"))


def _hard(s, d):
    """Hard negatives with a type too few, an id twice and a case without its flag."""
    x = table(s, d, "documents").select("doc_id")
    return x.select(F.expr("concat('H-', CASE WHEN doc_id = 5 THEN 4 ELSE doc_id END)").alias("case_id"), F.expr(case("doc_id % 3", ["scanner_only", "wrong_severity", "unrelated_evidence"])).alias("hard_negative_type"), F.expr("doc_id <> 7").alias("is_hard_negative"))


def _lines(s, d):
    """Lines with and without the context that a pattern needs."""
    texts = [
        "RabbitMQ at hostname = mq1, username=guest; password = pw", "hostname = mq1", "Author: Ann B. Clark wrote it", "author of the story", "The server: app.internal.test answers", "see app.internal.test",
    ]
    return table(s, d, "documents").select("doc_id", F.expr(case("doc_id % 6", texts)).alias("text"))


CONTEXT = ["RabbitMQ at hostname = [REDACTED_CREDENTIAL], username=[REDACTED_CREDENTIAL]; password = [REDACTED_CREDENTIAL]", "hostname = mq1", "Author: [REDACTED_NAME] wrote it", "author of the story", "The server: [REDACTED_HOST] answers", "see app.internal.test"]

def _faulty_records(s, d):
    """Normalized records as JSON with one fault each by their id: what breaks is known by hand."""
    raw = N_.normalized_findings(_raw(s, d))
    number = F.substring("document_id", 5, 6).cast("int")
    record = F.to_json(F.struct(*[c(x) for x in raw.columns if x != "document_id"]), {"ignoreNullFields": "false"})
    changed = F.when(number % 6 == 0, F.replace(record, F.lit('"schema_version":"0.2"'), F.lit('"schema_version":"0.1","more":1')))
    changed = changed.when(number % 6 == 1, F.replace(record, F.lit('"usage_scope":"internal"'), F.lit('"usage_scope":"anyone"'))).when(number % 6 == 2, F.replace(record, F.lit('"page_start":null'), F.lit('"page_start":0')))
    changed = changed.when(number % 6 == 3, F.replace(record, F.lit('"Remove it"'), F.lit('""'))).when(number % 6 == 4, F.replace(record, F.lit('"description":null'), F.lit('"note":null')))
    return raw.select(F.concat_ws("/", "document_id", "finding_id").alias("key"), changed.otherwise(record).alias("raw"))


def _catalogue_entries(s, d):
    x = table(s, d, "part").select("p_partkey")
    return x.select(
        F.expr("concat('KB-', p_partkey)").alias("kb_id"), F.expr(case("p_partkey % 3", ["sop", "taxonomy", "severity_guidance"])).alias("category"), F.expr(case("p_partkey % 4", ["info", "warning", "critical", "high"])).alias("severity"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN array('all', 'mars') ELSE array('api') END").alias("applicable_to"), F.expr(case("p_partkey % 2", ["evvo_rule", None])).alias("document_type"),
        F.expr(case("p_partkey % 7", ["internal"] * 6 + ["secret"])).alias("access_scope"), F.expr(case("p_partkey % 8", ["general"] * 7 + ["voodoo"])).alias("vulnerability_type"),
    )


MALFORMED = [
    # severity, weakness, address: as written, then as they must be read
    ("INFO", "cwe-79", "see <a href='https://a.example.test/x?y=1&amp;z=2'>this</a>", "informational", "CWE-79", None, "https://a.example.test/x?y=1&z=2"),
    ("weird", "CWE79: label", "HTTPS://B.example.test/path).", None, None, None, "HTTPS://B.example.test/path"),
    ("  High  ", "two: CWE-12 - and CWE-13", "http:///nohost,", "high", "CWE-12", "and CWE-13", "http:///nohost"),
    ("", "", "ftp://c.example.test", None, None, None, None),
    ("Critical!", "XCWE-5", "no address", None, None, None, None),
    (None, None, None, None, None, None, None),
]


def _malformed(s, d):
    rows = table(s, d, "documents").select("doc_id", *[F.expr(case("doc_id % 6", [x[i] for x in MALFORMED])).alias(n) for i, n in enumerate(("severity", "weakness", "address"))])
    return rows.select("doc_id", T.severity(c("severity")).alias("severity"), T.cwe_id(c("weakness")).alias("cwe"), T.cwe_description(c("weakness")).alias("description"), T.first_url(c("address")).alias("url"))


def _told(s, d):
    """Findings with placeholders and blank fields."""
    f = findings(s, d)
    return f.withColumns({
        "title": F.when(F.expr("doc_id % 10 = 1"), " TBD: ").otherwise(c("title")), "impact": F.when(F.expr("doc_id % 10 = 2"), "To be  determined.").otherwise(c("impact")),
        "recommendation": F.when(F.expr("doc_id % 10 = 3"), F.array(F.lit("Fix it"), F.lit("todo"), F.lit("placeholder."))).otherwise(c("recommendation")), "source_reference": F.when(F.expr("doc_id % 10 <> 4"), "blocks:1-2"),
        "evidence": F.when(F.expr("doc_id % 10 = 5"), F.transform("evidence", lambda e: e.withField("description", F.lit("Was not verified, automated SCAN")).withField("content", F.lit(None).cast("string")))).otherwise(c("evidence")),
    })


QUERIES = {
    "parse_malformed": _malformed,
    "prompts": lambda s, d: flat_findings(s, d).select("finding_id", F.sha2(D.prompt("Review the finding.", c("title")), 256).alias("digest")),
    "leakage_single": lambda s, d: D.leakage_risks(_examples(s, d).withColumn("engagement_id", F.lit("only"))),
    "schema_errors_full": lambda s, d: validation.errors(_faulty_records(s, d), "key", "raw", validation.NORMALIZED_SCHEMA),
    "structural_issues": lambda s, d: validation.structural_issues(findings(s, d)),
    "gated_reviews": lambda s, d: validation.gated_reviews(flat_findings(s, d), quality.governance_gate(flat_findings(s, d)), review(findings(s, d), only=["review_status"])),
    "entry_faults": lambda s, d: validation.entry_faults(_catalogue_entries(s, d)),
    "qc_placeholders": lambda s, d: quality.issues(_told(s, d)),
    "marker_order": lambda s, d: D.markers(_told(s, d)).select("finding_id", "positive", "negative", "scanner_only"),
    "qc_report": lambda s, d: quality.run_report(quality.status_of(findings(s, d), quality.issues(findings(s, d))), quality.duplicate_groups(table(s, d, "documents"), "doc_id", F.lit(""), c("text"))),
    "repeated_lines": lambda s, d: D.repeated_lines(_examples(s, d)),
    "engagement_report": lambda s, d: D.engagement_report(flat_findings(s, d)),
    "output_record": _record,
    "record_faults": _record_faults,
    "gated_records": lambda s, d: _gated(s, d).select("finding_id", "review_status", "classification.label", "confidence.level", F.get("review_comments", F.lit(0))["taxonomy_code"].alias("first_code"), F.when(c("classification.label") == "undetermined", F.get("review_comments", F.lit(0))["message"]).alias("message"), "human_escalation.recommended_reviewer", "traceability.source_document_id"),
    "gated_counts": _gated_faults,
    "kb_result_summary": lambda s, d: N.result_summary(N.retrieve(_kb_entries(s, d), _kb_queries(s, d))).select("query_id", "total", F.array_join("categories", ",").alias("categories")),
    "source_class": lambda s, d: _entries(s, d).select("doc_id", M.source_class(c("source"), c("category"), c("subcategory")).alias("x")).select("doc_id", "x.*"),
    "vulnerability_type": lambda s, d: _entries(s, d).select("doc_id", M.vulnerability_type(c("title"), c("tags")).alias("kind")),
    "kb_filters": lambda s, d: _hits(s, d).select("query_id", "kb_id", "severity", c("rank").cast("long").alias("rank")),
    "kb_by_id": lambda s, d: N.by_id(_kb_entries(s, d), "KB-7").select("kb_id", "category", "severity"),
    "kb_of_category": lambda s, d: N.of_category(_kb_entries(s, d), "escalation_rules").select("kb_id", "severity"),
    "kb_rules_text": lambda s, d: N.rules_text(_hits(s, d), _kb_entries(s, d)),
    "kb_rules_summary": lambda s, d: N.rules_summary(_hits(s, d), _kb_entries(s, d)).select("query_id", c("rank").cast("long").alias("rank"), "kb_id", "title", "action", "severity"),
    "kb_chunks": lambda s, d: _kb_entries(s, d).select("kb_id", N.chunk_text().alias("text")),
    "embedded_chunks": lambda s, d: N.embedded(_kb_entries(s, d).select("kb_id", N.chunk_text().alias("text")), N.stub_embedder, "kb_id", "text").select("id", c("embedding")[0].alias("length"), c("embedding")[1].alias("spaces")),
    "entry_defaults": _typed_entries,
    "unit_vectors": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(N.inner_product(N.normalized(c("embedding")), N.normalized(c("embedding")))), 6).alias("norm"), F.round(N.normalized(c("embedding"))[0], 6).alias("first")),
    "retrieval_methods": _methods,
    "eligible_tasks": lambda s, d: D.eligible_tasks(findings(s, d)),
    "task_inventory": lambda s, d: D.task_inventory(findings(s, d)),
    "dataset_envelope": lambda s, d: D.envelope(_cases(s, d).select("task_type", F.lit("Answer.").alias("instruction"), c("finding_id").alias("input"), "gold_output")).select("task_type", "instruction", "input", "content_hash"),
    "repeated_hashes": lambda s, d: D.repeated_hashes(table(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))),
    "unsupported_questions": lambda s, d: D.unsupported_questions(findings(s, d), _questions(s, d)).select("finding_id", "question", "refusal_reason", "hard_negative_type", F.get_json_object("gold_output", "$.refuses").alias("refuses")),
    "hard_negative_faults": lambda s, d: D.hard_negative_faults(_hard(s, d), {"scanner_only": 1, "absent": 2}),
    "count_deltas": lambda s, d: D.count_deltas(flat_findings(s, d).where("doc_id % 2 = 0"), flat_findings(s, d), "severity"),
    "count_ranks": lambda s, d: D.count_ranks(table(s, d, "conversations"), "role").select("role", "n", c("rank").cast("long").alias("rank")),
    "freeze_manifest": lambda s, d: D.freeze_manifest(D.group_split(table(s, d, "documents"), "source"), table(s, d, "documents"), "source"),
    "compared_cases": lambda s, d: _compared(s, d).select("case_id", "task_type", "json_valid", "exact_match", "structure", c("matched").cast("long").alias("matched"), c("compared").cast("long").alias("compared"), "classification_match", "tier"),
    "comparison_report": lambda s, d: E.comparison_report(_compared(s, d)),
    "selected_cases": lambda s, d: E.selected(_eval_cases(s, d), first=10).select("case_id", "task_type"),
    "failure_codes": lambda s, d: E.failure_codes(_modes(s, d), "doc_id", "modes"),
    "context_redaction": lambda s, d: _lines(s, d).select("doc_id", X.redacted_by_context(c("text")).alias("text")),
    "tag_faults": lambda s, d: _lines(s, d).select("doc_id", X.malformed_tags(F.concat(X.redacted_by_context(c("text")), F.when(c("doc_id") % 9 == 0, " [REDACTED_x] [REDACTED").otherwise(""))).cast("long").alias("faults")),
}

ORACLE_SQL = {
    "parse_malformed": f"SELECT doc_id, {case('doc_id % 6', [x[3] for x in MALFORMED])} AS severity, {case('doc_id % 6', [x[4] for x in MALFORMED])} AS cwe, {case('doc_id % 6', [x[5] for x in MALFORMED])} AS description, {case('doc_id % 6', [x[6] for x in MALFORMED])} AS url FROM documents",
    "prompts": f"{WITH} SELECT finding_id, sha256('<|im_start|>system' || chr(10) || 'Review the finding.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || title || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS digest FROM findings",
    "leakage_single": f"{EXAMPLES} SELECT 'LEAK-002' AS risk_id, 'high' AS severity, finding_id AS subject, count(*) AS n FROM examples GROUP BY finding_id HAVING count(*) > 1 UNION ALL SELECT 'LEAK-003', 'critical', content_hash, count(*) FROM examples GROUP BY content_hash HAVING count(*) > 1 UNION ALL SELECT 'LEAK-001', 'critical', 'engagement', count(*) FROM documents UNION ALL SELECT 'LEAK-004', 'medium', 'template', count(*) FROM documents UNION ALL SELECT 'LEAK-005', 'high', 'small set', greatest(1, count(*) // 10) FROM documents",
    "schema_errors_full": f"""{DOCS}, kept AS (SELECT document_id || '/' || finding_id AS key, doc_id, CASE WHEN doc_id % 5 = 2 THEN true ELSE false END AS fixed FROM m SEMI JOIN s USING (document_id, finding_id))
        SELECT key, '<root>' AS path, 'has additional properties' AS message FROM kept WHERE doc_id % 6 = 0 UNION ALL SELECT key, 'schema_version', 'is not the constant' FROM kept WHERE doc_id % 6 = 0
        UNION ALL SELECT key, 'governance.usage_scope', 'is not one of the listed values' FROM kept WHERE doc_id % 6 = 1 UNION ALL SELECT key, 'source.location.page_start', 'is under the minimum' FROM kept WHERE doc_id % 6 = 2
        UNION ALL SELECT key, 'recommendation[0]', 'is too short' FROM kept WHERE doc_id % 6 = 3 UNION ALL SELECT key, 'affected_targets[0]', 'has additional properties' FROM kept WHERE doc_id % 6 = 4
        UNION ALL SELECT key, 'retest.status', 'is not one of the listed values' FROM kept WHERE fixed""",
    "structural_issues": f"""{WITH} SELECT finding_id, 'cvss.vector' AS field, 'warning' AS severity FROM findings WHERE doc_id % 4 = 2 UNION ALL SELECT finding_id, 'cwe_id', 'warning' FROM findings WHERE doc_id % 8 = 6
        UNION ALL SELECT finding_id, 'observation', 'warning' FROM findings WHERE length(trim(coalesce(observation, ''), ' ')) < 10 UNION ALL SELECT finding_id, 'finding_id', 'error' FROM findings WHERE length(finding_id) <> 10""",
    "gated_reviews": f"{ESCALATED} SELECT finding_id, CASE WHEN usage_approved IS TRUE AND usage_scope <> 'public' AND length(finding_id) = 10 THEN {STATUS} ELSE 'human_review' END AS review_status, coalesce(usage_approved IS TRUE AND usage_scope <> 'public' AND length(finding_id) = 10, false) AS reviewed FROM escalated",
    "entry_faults": "SELECT 'KB-' || p_partkey AS kb_id, 'category' AS field, 'taxonomy' AS value FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'KB-' || p_partkey, 'severity', 'high' FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT 'KB-' || p_partkey, 'applicable_to', 'mars' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'KB-' || p_partkey, 'access_scope', 'secret' FROM part WHERE p_partkey % 7 = 6 UNION ALL SELECT 'KB-' || p_partkey, 'vulnerability_type', 'voodoo' FROM part WHERE p_partkey % 8 = 7",
    "qc_placeholders": f"""{QC_SQL} SELECT * FROM issues WHERE NOT (field = 'impact' AND CAST(substr(finding_id, 5) AS BIGINT) % 10 = 2) AND NOT (field = 'recommendation' AND CAST(substr(finding_id, 5) AS BIGINT) % 10 = 3)
        UNION ALL SELECT finding_id, 'QC-CONTENT-002' AS check_id, 'warning' AS severity, 'title' AS field FROM findings WHERE doc_id % 10 = 1 UNION ALL SELECT finding_id, 'QC-CONTENT-002', 'warning', 'impact' FROM findings WHERE doc_id % 10 = 2
        UNION ALL SELECT finding_id, 'QC-CONTENT-002', 'warning', 'recommendation[' || i || ']' FROM findings, (SELECT unnest([1, 2]) AS i) WHERE doc_id % 10 = 3 UNION ALL SELECT finding_id, 'QC-SOURCE-002', 'error', 'source.source_reference' FROM findings WHERE doc_id % 10 = 4""",
    "marker_order": f"{MARKED} SELECT finding_id, CASE WHEN doc_id % 10 = 5 AND n_evidence > 0 THEN {_like(chr(39) + 'was not verified, automated scan ' + chr(39) + ' || lower(coalesce(observation, ' + chr(39) * 2 + '))', POSITIVE)} ELSE positive END AS positive, CASE WHEN doc_id % 10 = 5 AND n_evidence > 0 THEN true WHEN doc_id % 10 = 5 THEN negative ELSE negative END AS negative, CASE WHEN doc_id % 10 = 5 AND n_evidence > 0 THEN NOT {_like('lower(coalesce(observation, ' + chr(39) * 2 + '))', POSITIVE)} ELSE {_like('ev', SCANNERS)} AND NOT positive END AS scanner_only FROM flagged",
    "qc_report": f"""{QC_SQL}, dups AS (SELECT count(*) AS n FROM (SELECT regexp_replace(lower(chr(10) || coalesce(text, '')), '{WS}', ' ', 'g') AS t FROM documents) GROUP BY trim(t) HAVING count(*) > 1)
        SELECT 'status' AS kind, 'passed' AS value, count_if(status = 'passed')::BIGINT AS n FROM statuses UNION ALL SELECT 'status', 'needs_review', count_if(status = 'needs_review') FROM statuses UNION ALL SELECT 'status', 'blocked', count_if(status = 'blocked') FROM statuses
        UNION ALL SELECT 'issues', 'error', sum(errors) FROM statuses UNION ALL SELECT 'issues', 'warning', sum(warnings) FROM statuses UNION ALL SELECT 'duplicates', 'groups', count(*) FROM dups UNION ALL SELECT 'duplicates', 'findings', coalesce(sum(n), 0) FROM dups""",
    "repeated_lines": f"{EXAMPLES} SELECT content_hash, line, min(line) OVER (PARTITION BY content_hash) AS first_line FROM examples QUALIFY count(*) OVER (PARTITION BY content_hash) > 1",
    "engagement_report": f"{WITH} SELECT coalesce(engagement_id, 'UNKNOWN') AS engagement_id, count(*) AS findings, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'high')::BIGINT AS high, count_if(severity = 'medium')::BIGINT AS medium, count_if(severity = 'low')::BIGINT AS low, count_if(severity = 'informational')::BIGINT AS informational, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM findings GROUP BY 1",
    "output_record": f"""{ESCALATED} SELECT '0.1' AS schema_version, finding_id, {STATUS} AS review_status, CASE WHEN severity <> band THEN band ELSE severity END AS suggested_severity, severity AS reported_severity, severity = band AS severity_matches_score, {_COMPLETE}::BIGINT AS n_completeness,
        {_sql_codes([(cond, code) for cond, code, _ in _LISTED])} AS codes, array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'coalesce({cond}, false)' for cond, _, sev in _LISTED if sev == kind)} THEN {quoted(kind)} END" for kind in ("error", "suggestion", "warning"))}], lambda x: x IS NOT NULL), ',') AS kinds,
        confidence_score AS overall_score, CASE WHEN severity IN ('critical', 'high') THEN 'senior_pentester' WHEN coalesce(severity <> band, false) THEN 'report_reviewer' END AS recommended_reviewer, {_sql_codes([(v.replace("judged.finding_id", "escalated.finding_id"), k) for k, v in ISSUES.items()])} AS issues,
        document_id AS source_document_id, '1.0' AS ruleset_version, '2024-01-01T00:00:00+00:00' AS reviewed_at, 18 AS n_fields,
        coalesce((SELECT string_agg(evidence_id, ',' ORDER BY i) FROM evidence e WHERE e.finding_id = escalated.finding_id), '') AS reviewed, success + CASE WHEN coalesce(sufficient, false) THEN 1 ELSE 0 END AS n_supported,
        CASE WHEN rec = '' THEN 'No recommendation provided' WHEN NOT ({_ROOT}) THEN 'Recommendation may not address root cause for ' || cwe_id ELSE '' END AS advice,
        CASE {_RETEST} WHEN 'untested' THEN 'No retest performed' WHEN 'unshown' THEN 'Retest status is ' || chr(39) || retest_status || chr(39) || ' but no retest evidence provided' ELSE '' END AS unproven,
        CASE WHEN imp = '' THEN 1 ELSE {' + '.join(f"CASE WHEN contains(imp, '{w}') AND NOT contains(ev, '{w}') THEN 1 ELSE 0 END" for w in ("unauthorized", "data", "access", "exposure", "bypass", "compromise"))} END::BIGINT AS n_impact_claims,
        CASE WHEN retest_status = 'someday' THEN 'unknown' ELSE retest_status END AS reported_status FROM escalated""",
    "gated_records": f"""{ESCALATED}, firsts AS (SELECT *, {_sql_codes([(cond, code) for cond, code, _ in _LISTED])} AS codes FROM escalated)
        SELECT finding_id, CASE WHEN {_PASSES} THEN {STATUS} ELSE 'human_review' END AS review_status, CASE WHEN {_PASSES} THEN {LABEL} ELSE 'undetermined' END AS label, CASE WHEN NOT ({_PASSES}) THEN 'not_calculated' WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS level,
        CASE WHEN {_PASSES} THEN split_part(codes, ',', 1) ELSE 'COMP-000' END AS first_code, CASE WHEN NOT ({_PASSES}) THEN 'Input validation failed: ' || CASE WHEN doc_id % 7 = 6 THEN 'unknown' ELSE 'severity ' || coalesce(severity, 'missing') END END AS message,
        CASE WHEN NOT ({_PASSES}) THEN 'technical_reviewer' WHEN severity IN ('critical', 'high') THEN 'senior_pentester' WHEN coalesce(severity <> band, false) THEN 'report_reviewer' END AS recommended_reviewer, document_id AS source_document_id FROM firsts""",
    "gated_counts": f"{ESCALATED} SELECT 'outcome' AS kind, CASE WHEN {_PASSES} THEN {STATUS} ELSE 'error' END AS value, count(*) AS n FROM escalated GROUP BY 2",
    "kb_result_summary": f"{HITS.replace(' QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY weight DESC, kb_id) <= 10', '')} SELECT query_id, count(*) AS total, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hits GROUP BY 1",
    "record_faults": """SELECT 'FND-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-spoilt' AS finding_id, e.path, e.message FROM documents JOIN (VALUES (1, 'traceability.reviewed_at', 'is not a date-time'), (3, 'severity_review', 'lacks required property change_recommended'),
        (3, 'severity_review', 'has additional properties'), (4, 'confidence.level', 'is not one of the listed values')) AS e(kind, path, message) ON doc_id % 5 = kind
        UNION ALL SELECT finding_id || '-spoilt', 'review_comments[' || (count(*) - 1) || '].suggested_action', 'is too short' FROM (""" + f"{_LONG} SELECT finding_id FROM long WHERE CAST(substr(finding_id, 5, 6) AS BIGINT) % 5 = 2" + """) GROUP BY finding_id""",
    "source_class": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'POLICY-review_taxonomy' WHEN 1 THEN 'DOC-problem_definition' WHEN 2 THEN 'EVVO-SOP-internal' WHEN 3 THEN 'REF-MITRE-CWE' WHEN 6 THEN 'SCHEMA-output_schema' WHEN 7 THEN 'REF-CVSS-3.1'
        ELSE CASE doc_id % 3 WHEN 0 THEN 'DOC-problem_definition' WHEN 1 THEN 'SCHEMA-registry' ELSE 'EVVO-internal' END END AS source_id,
        CASE doc_id % 8 WHEN 0 THEN 'policy_document' WHEN 1 THEN 'internal_guideline' WHEN 2 THEN 'evvo_sop' WHEN 3 THEN 'internal_guideline' WHEN 6 THEN 'schema_definition' WHEN 7 THEN 'internal_guideline'
        ELSE CASE doc_id % 3 WHEN 0 THEN 'evvo_sop' WHEN 1 THEN 'schema_definition' ELSE 'evvo_rule' END END AS document_type,
        CASE doc_id % 3 WHEN 0 THEN CASE doc_id % 4 WHEN 0 THEN 'pipeline:pipeline_step' WHEN 1 THEN 'sop:escalation' ELSE 'sop:' END
        ELSE CASE doc_id % 3 WHEN 1 THEN 'taxonomy_definitions' ELSE 'severity_guidance' END || CASE doc_id % 4 WHEN 0 THEN ':pipeline_step' WHEN 1 THEN ':escalation' ELSE '' END END AS section FROM documents""",
    "vulnerability_type": """SELECT doc_id, CASE WHEN doc_id % 14 = 0 OR doc_id % 4 = 2 THEN 'hardcoded_credentials' WHEN doc_id % 14 = 1 OR doc_id % 4 = 1 THEN 'weak_crypto_algorithm' ELSE CASE doc_id % 14 WHEN 2 THEN 'missing_root_detection' WHEN 3 THEN 'weak_ssl_pinning'
        WHEN 4 THEN 'user_enumeration' WHEN 5 THEN 'xss' WHEN 6 THEN 'sqli' WHEN 7 THEN 'csrf' WHEN 8 THEN 'authorization_bypass' WHEN 9 THEN 'authentication_bypass' WHEN 10 THEN 'information_disclosure' WHEN 11 THEN 'business_logic' ELSE 'general' END END AS kind FROM documents""",
    "kb_filters": f"{HITS} SELECT query_id, kb_id, severity, rank FROM hits",
    "kb_by_id": f"WITH {KB_ROWS} SELECT kb_id, category, severity FROM kb WHERE k = 7",
    "kb_of_category": f"WITH {KB_ROWS} SELECT kb_id, severity FROM kb WHERE k % 4 = 2",
    "kb_rules_text": f"""{HITS}, t AS (SELECT query_id, rank, '[' || kb_id || '] ' || title || coalesce(chr(10) || '  Description: ' || description, '') || coalesce(chr(10) || '  Conditions: ' || conditions, '') || coalesce(chr(10) || '  Action: ' || action, '') || chr(10) AS line FROM hits)
        SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS text FROM t GROUP BY 1""",
    "kb_rules_summary": f"{HITS} SELECT query_id, rank, kb_id, title, coalesce(action, '') AS action, severity FROM hits",
    "kb_chunks": f"WITH {KB_ROWS} SELECT kb_id, '[' || kb_id || '] ' || title || coalesce(chr(10) || description, '') || coalesce(chr(10) || 'Conditions: ' || conditions, '') || coalesce(chr(10) || 'Action: ' || action, '') AS text FROM kb",
    "embedded_chunks": f"WITH {KB_ROWS}, t AS (SELECT kb_id, '[' || kb_id || '] ' || title || coalesce(chr(10) || description, '') || coalesce(chr(10) || 'Conditions: ' || conditions, '') || coalesce(chr(10) || 'Action: ' || action, '') AS text FROM kb) SELECT kb_id AS id, length(text)::DOUBLE AS length, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM t",
    "entry_defaults": """SELECT 'KB-' || doc_id AS kb_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 2 THEN NULL ELSE 'T' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'info' ELSE 'critical' END AS severity, CASE WHEN doc_id % 5 = 0 THEN 'api,x' ELSE 'all' END AS targets, '' AS conditions, '1.0' AS version, 'general' AS vulnerability_type, 19 AS fields FROM documents""",
    "unit_vectors": "SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
    "retrieval_methods": f"""{KB_SQL}, m AS (SELECT 'metadata' AS method, query_id, count_if(list_contains(expected, kb_id)) / length(any_value(expected))::DOUBLE AS recall, count_if(rank <= 5 AND list_contains(relevant, kb_id)) / least(5, count(*))::DOUBLE AS precision FROM hits GROUP BY query_id
        UNION ALL SELECT 'first_three', query_id, count_if(list_contains(expected, kb_id)) / length(any_value(expected))::DOUBLE, count_if(list_contains(relevant, kb_id)) / least(3, count(*))::DOUBLE FROM hits WHERE rank <= 3 GROUP BY query_id)
        SELECT method, count(*) AS queries, round(avg(recall), 4) AS mean_recall, round(avg(precision), 4) AS mean_precision, round(count_if(recall = 1) / count(*)::DOUBLE, 4) AS pass_rate FROM m GROUP BY 1""",
    "eligible_tasks": f"""{MARKED} SELECT finding_id, 'client_qa' AS task_type FROM flagged UNION ALL SELECT finding_id, 'finding_review' FROM flagged WHERE coalesce(observation, '') <> '' AND n_evidence > 0 AND recommendation_text <> '' UNION ALL SELECT finding_id, 'severity_review' FROM flagged WHERE severity IS NOT NULL AND score IS NOT NULL AND vector IS NOT NULL
        UNION ALL SELECT finding_id, 'evidence_check' FROM flagged WHERE n_evidence > 0 UNION ALL SELECT finding_id, 'remediation_review' FROM flagged WHERE recommendation_text <> '' UNION ALL SELECT finding_id, 'hard_negative_potential_issue' FROM flagged WHERE negative""",
    "dataset_envelope": f"{MARKED} SELECT task_type, 'Answer.' AS instruction, finding_id AS input, sha256(task_type || chr(31) || finding_id)[1:16] AS content_hash FROM cases",
    "repeated_hashes": "SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "unsupported_questions": f"{WITH} SELECT finding_id, 'Which version was used?' AS question, 'no version is told' AS refusal_reason, 'unsupported_question' AS hard_negative_type, 'true' AS refuses FROM findings",
    "hard_negative_faults": "SELECT 'number' AS fault, subject, n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'scanner_only' WHEN 1 THEN 'wrong_severity' ELSE 'unrelated_evidence' END AS subject, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'absent', 0) WHERE NOT (subject = 'scanner_only' AND n = 1) UNION ALL SELECT 'duplicate_id', 'H-4', 2 UNION ALL SELECT 'not_flagged', 'H-7', 1",
    "count_deltas": f"{WITH} SELECT coalesce(severity, 'unknown') AS severity, count_if(doc_id % 2 = 0)::BIGINT AS n_old, count(*) AS n_new, count(*) - count_if(doc_id % 2 = 0)::BIGINT AS delta FROM findings GROUP BY 1",
    "count_ranks": "SELECT role, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, role) AS rank FROM conversations GROUP BY 1",
    "freeze_manifest": "WITH g AS (SELECT coalesce(source, 'UNKNOWN') AS source, count(*) AS n FROM documents GROUP BY 1) SELECT CASE WHEN count(*) < 2 THEN 'NOT_FROZEN' ELSE 'FROZEN' END AS status, count(*) AS groups, CASE WHEN count(*) < 2 THEN 0 ELSE 1 END::BIGINT AS test_groups, CASE WHEN count(*) < 2 THEN 0 ELSE (SELECT n FROM g ORDER BY n, source DESC LIMIT 1) END AS test_examples FROM g",
    "compared_cases": f"{COMPARED} SELECT * FROM r",
    "comparison_report": f"{COMPARED} SELECT count(*) AS cases, count_if(json_valid)::BIGINT AS valid, count_if(exact_match)::BIGINT AS exact, count_if(classification_match)::BIGINT AS classification_right, count(classification_match) AS classification_compared, round(avg(structure), 4) AS mean_structure, CASE WHEN count_if(json_valid) > count(*) * 0.5 THEN 'PARTIAL' ELSE 'INVESTIGATE' END AS verdict FROM r",
    "selected_cases": f"{COMPARED} SELECT case_id, task_type FROM x ORDER BY case_id LIMIT 10",
    "failure_codes": f"SELECT doc_id, mode, code FROM documents JOIN (VALUES {_MODE_CODES}) AS m(kind, mode, code) ON doc_id % 4 = kind",
    "context_redaction": f"SELECT doc_id, {case('doc_id % 6', CONTEXT)} AS text FROM documents",
    "tag_faults": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END::BIGINT AS faults FROM documents",
}
_TASKS = ORACLE_SQL["eligible_tasks"]
ORACLE_SQL["task_inventory"] = f"{_TASKS[: _TASKS.index(' SELECT finding_id, ' + quoted('client_qa'))]}, tasks AS ({_TASKS[_TASKS.index('SELECT finding_id, ' + quoted('client_qa')) :]}) SELECT 'task' AS kind, task_type AS value, count(*) AS n FROM tasks GROUP BY 2 UNION ALL SELECT 'severity', coalesce(severity, 'missing'), count(*) FROM findings GROUP BY 2 UNION ALL SELECT 'redaction', redaction_status, count(*) FROM findings GROUP BY 2 UNION ALL SELECT 'exploitation', CASE WHEN negative THEN 'denied' WHEN positive THEN 'shown' WHEN {_like('ev', SCANNERS)} THEN 'scanner_only' ELSE 'unclear' END, count(*) FROM flagged GROUP BY 2"
