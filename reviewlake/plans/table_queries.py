"""Queries of quality checks, text functions, segmentation and retrieval, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands, text
from ..functions.values import CODE_TO_KB as text_map
from ..operators import migration, quality, retrieval, segmentation
from .review_queries import KW
from .synthetic import WITH, findings, flat_findings, quoted, table

c = F.col
B_CLOSED = "CASE WHEN score BETWEEN 9.0 AND 10.0 THEN 'critical' WHEN score BETWEEN 7.0 AND 8.9 THEN 'high' WHEN score BETWEEN 4.0 AND 6.9 THEN 'medium' WHEN score BETWEEN 0.1 AND 3.9 THEN 'low' WHEN score = 0.0 THEN 'informational' END"
B_OPEN = "CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score {} THEN 'low' WHEN score IS NOT NULL THEN 'informational' END"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _nested(spark, sf_dir):
    return findings(spark, sf_dir)


def _issues(spark, sf_dir):
    return quality.issues(_nested(spark, sf_dir))


def _statuses(spark, sf_dir):
    f = _nested(spark, sf_dir)
    return quality.status_of(f, quality.issues(f))


def _blocks(spark, sf_dir):
    """Conversations as ordered blocks of documents; the first words of user turns stand for labels."""
    t = table(spark, sf_dir, "conversations")
    label = F.expr("CASE turn % 4 WHEN 0 THEN 'Observations:' WHEN 1 THEN NULL WHEN 2 THEN 'Proof of  Concept' ELSE NULL END")
    return t.select("conv_id", "turn", "role", "text", label.alias("label"))


LABEL_SQL = "CASE turn % 4 WHEN 0 THEN 'observation' WHEN 2 THEN 'exploitation' END"


def _field_rows(spark, sf_dir):
    """Key/value rows of metadata tables: three labels of each finding, one of them unknown at times."""
    f = flat_findings(spark, sf_dir).select("finding_id", "doc_id", "severity", "cwe_id", "score")
    cells = "array(struct('Severity' AS label, severity AS value), struct(CASE WHEN doc_id % 10 = 0 THEN 'Owner' ELSE 'CWE-ID:' END AS label, cwe_id AS value), struct('CVSS (Score)' AS label, cast(score AS string) AS value))"
    return f.select("finding_id", F.posexplode(F.expr(cells)).alias("row", "x")).select("finding_id", "row", "x.label", "x.value")


def _query_vectors(v):
    return v.where("vec_id % 100 = 0")


def _topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(v, _query_vectors(v), 5)


def _by_label(s, d):
    """Metadata hits of each query: the twenty smallest ids of its label."""
    v = table(s, d, "embeddings").select(c("vec_id").alias("id"), "label")
    first = v.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("rank <= 20")
    queries = _query_vectors(table(s, d, "embeddings")).select(c("vec_id").alias("query_id"), "label")
    return queries.join(first, "label").select("query_id", "id", "rank")


#: Entries made of ``part``, beside the catalogue's own: (id, category, severity, targets), the same text for both engines but for arrays.
PART_ENTRIES = """SELECT 'KB-' || p_partkey AS kb_id, CASE p_partkey % 4 WHEN 0 THEN 'severity_guidance' WHEN 1 THEN 'evidence_standards' WHEN 2 THEN 'escalation_rules' ELSE 'consistency_rules' END AS category,
 CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE p_partkey % 5 WHEN 0 THEN {all} WHEN 1 THEN {api} ELSE {android} END AS applicable_to FROM {part}"""


def _catalogue(spark, sf_dir):
    """The catalogue and an entry for each part."""
    made = spark.sql(PART_ENTRIES.format(all="array('all')", api="array('api')", android="array('android_application')", part="{part}"), part=table(spark, sf_dir, "part"))
    return retrieval.catalogue(spark).select("kb_id", "category", "severity", "applicable_to").unionByName(made)


def _kb(spark, sf_dir):
    return retrieval.retrieve(_catalogue(spark, sf_dir), retrieval.gold_queries(spark))


def _kb_values() -> str:
    return ", ".join(f"({quoted(i)}, {quoted(cat)}, {quoted(s)}, {[*a]!r})" for i, cat, s, a in retrieval.CATALOGUE)


def _gold_values() -> str:
    rows = []
    for q, codes, domain, cats, exp, rel in retrieval.GOLD_QUERIES:
        mapped = sorted({text_map[x] for x in codes}) if codes else None
        wanted = sorted(set(mapped) if mapped else set()) or None
        rows.append(f"({quoted(q)}, {wanted!r}, {quoted(domain)}, {cats!r}, {exp!r}, {rel!r})".replace("None", "NULL"))
    return ", ".join(rows)


KB_SQL = f"""WITH fixed(kb_id, category, severity, applicable_to) AS (VALUES {_kb_values()}), kb AS (SELECT * FROM fixed UNION ALL {PART_ENTRIES.format(all="['all']", api="['api']", android="['android_application']", part="part")}), gold(query_id, wanted, domain, cats, expected, relevant) AS (VALUES {_gold_values()}),
hits AS (SELECT query_id, kb_id, category, severity, expected, relevant, row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, kb_id) AS rank
 FROM gold, kb WHERE (wanted IS NULL OR list_contains(wanted, category)) AND (domain = 'all' OR list_contains(applicable_to, 'all') OR list_contains(applicable_to, domain)) AND (cats IS NULL OR list_contains(cats, category)))"""
TOPK_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_inner_product(e::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{85}]+"
QC_SQL = f"""{WITH}, band AS (SELECT *, {B_CLOSED} AS band FROM findings),
issues AS (
  SELECT finding_id, 'QC-CONTENT-001' AS check_id, 'error' AS severity, 'impact' AS field FROM band WHERE impact IS NULL
  UNION ALL SELECT finding_id, 'QC-CONTENT-001', 'error', 'observation' FROM band WHERE observation IS NULL OR trim(observation) = ''
  UNION ALL SELECT finding_id, 'QC-CONTENT-001', 'error', 'evidence' FROM band WHERE n_evidence = 0
  UNION ALL SELECT finding_id, 'QC-CONTENT-001', 'error', 'recommendation' FROM band WHERE recommendation_text = ''
  UNION ALL SELECT finding_id, 'QC-CVSS-001', 'warning', 'severity' FROM band WHERE severity <> band
  UNION ALL SELECT finding_id, 'QC-RETEST-001', 'warning', 'retest' FROM band WHERE retest_status IS NULL
  UNION ALL SELECT finding_id, 'QC-RETEST-002', 'warning', 'retest.verification_result' FROM band WHERE retest_status IS NOT NULL
  UNION ALL SELECT finding_id, 'QC-GOV-001', 'error', 'governance.usage_approved' FROM band WHERE usage_approved IS NOT TRUE
  UNION ALL SELECT finding_id, 'QC-GOV-002', 'warning', 'governance.usage_scope' FROM band WHERE usage_scope IS DISTINCT FROM 'internal'),
rolled AS (SELECT f.finding_id, count_if(i.severity = 'error') AS errors, count_if(i.severity = 'warning') AS warnings FROM findings f LEFT JOIN issues i USING (finding_id) GROUP BY 1),
statuses AS (SELECT *, CASE WHEN errors > 0 THEN 'blocked' WHEN warnings > 0 THEN 'needs_review' ELSE 'passed' END AS status FROM rolled)"""

QUERIES = {
    "bands": lambda s, d: flat_findings(s, d).select("finding_id", bands.review_band(c("score")).alias("review"), bands.quality_band(c("score")).alias("quality"), bands.benchmark_band(c("score")).alias("benchmark"), bands.merge_band(c("score")).alias("merge"), bands.hard_negative_band(c("score")).alias("hard_negative")),
    "normalize_whitespace": lambda s, d: _docs(s, d).select("doc_id", F.sha2(text.normalize_whitespace(c("text")), 256).alias("digest")),
    "parse_severity": lambda s, d: flat_findings(s, d).select("finding_id", text.severity(F.concat(F.lit("  "), F.upper("severity"), F.lit(" "))).alias("severity")),
    "parse_cwe": lambda s, d: flat_findings(s, d).select("finding_id", text.cwe_id(F.concat("cwe_id", F.lit(": "), "title")).alias("cwe"), text.cwe_description(F.concat("cwe_id", F.lit(": "), "title")).alias("description")),
    "parse_cvss": lambda s, d: flat_findings(s, d).select("finding_id", text.cvss(F.concat(F.col("score").cast("decimal(4,2)").cast("string"), F.lit(" ("), F.coalesce("vector", F.lit("none")), F.lit(")"))).alias("x")).select("finding_id", "x.score", "x.version", "x.vector", "x.parse_successful"),
    "extract_url": lambda s, d: table(s, d, "pages").select("page_id", text.first_url(F.concat(F.lit("see ("), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(").,"))).alias("url"), F.try_parse_url("url", F.lit("HOST")).alias("host")),
    "target_type": lambda s, d: flat_findings(s, d).select("finding_id", text.target_type(c("title")).alias("target_type")),
    "keywords": lambda s, d: flat_findings(s, d).select("finding_id", F.array_join(text.keywords(c("title")), " ").alias("words"), F.size(text.keywords(c("observation"))).cast("long").alias("n_observation")),
    "truncate_snippet": lambda s, d: _docs(s, d).select("doc_id", F.sha2(text.truncated(c("text"), 120), 256).alias("digest")),
    "content_hash": lambda s, d: flat_findings(s, d).select("finding_id", text.content_hash(c("finding_id"), c("title"), c("severity")).alias("hash")),
    "json_extract": lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")),
    "qc_issues": _issues,
    "qc_status": lambda s, d: _statuses(s, d),
    "qc_summary": lambda s, d: quality.run_summary(_statuses(s, d)),
    "exact_duplicates": lambda s, d: quality.duplicate_groups(_docs(s, d), "doc_id", F.lit(""), c("text")),
    "governance_gate": lambda s, d: quality.governance_gate(flat_findings(s, d)),
    "key_faults": lambda s, d: quality.key_faults(table(s, d, "lineitem").select("l_orderkey"), "l_orderkey"),
    "key_set_differences": lambda s, d: quality.key_set_differences(table(s, d, "orders").select(c("o_custkey").alias("k")), table(s, d, "customer").select(c("c_custkey").alias("k")), table(s, d, "lineitem").select(c("l_suppkey").alias("k")), "k"),
    "enum_domain": lambda s, d: quality.outside_domain(flat_findings(s, d), {"severity": ["critical", "high", "medium", "low", "informational"], "usage_scope": ["internal", "evaluation_only"]}, "finding_id"),
    "segment_ffill": lambda s, d: segmentation.forward_fill(_blocks(s, d), "conv_id", "turn", segmentation.section_of(c("label"))).select("conv_id", "turn", "segment"),
    "segment_interval_join": lambda s, d: segmentation.segment_stats(segmentation.owned_blocks(_blocks(s, d), segmentation.intervals(_blocks(s, d), "conv_id", "turn", c("role") == "user"), "conv_id", "turn"), ["conv_id", "ordinal"], "turn", "text"),
    "section_collect": lambda s, d: segmentation.sections(_blocks(s, d), "conv_id", "turn", "label", "text").select("conv_id", "section", F.size("paragraphs").cast("long").alias("n"), F.sha2("combined_text", 256).alias("digest")),
    "missing_sections": lambda s, d: segmentation.missing_sections(segmentation.sections(_blocks(s, d), "conv_id", "turn", "label", "text"), _blocks(s, d), "conv_id"),
    "context_frame": lambda s, d: segmentation.context_frame(_blocks(s, d), "conv_id", "turn", c("text").contains("and"), 1, 2).select("conv_id", "turn", "is_match"),
    "block_inventory": lambda s, d: _blocks(s, d).select("conv_id", "turn", F.expr("row_number() over (partition by conv_id order by turn)").cast("long").alias("block_number"), F.expr("count_if(role = 'user') over (partition by conv_id order by turn)").alias("user_number")),
    "field_pivot": lambda s, d: segmentation.pivot_fields(_field_rows(s, d), "finding_id", "label", "value", "row").select("finding_id", "severity", "cwe", "cvss"),
    "field_faults": lambda s, d: segmentation.field_faults(_field_rows(s, d), "finding_id", "label"),
    "missing_fields": lambda s, d: segmentation.missing_fields(_field_rows(s, d), "finding_id", "label", ["severity", "cwe", "impact"]).select("finding_id", F.array_join("missing", ",").alias("missing")),
    "three_way_join": lambda s, d: segmentation.assembled(table(s, d, "orders").select(c("o_orderkey").alias("k"), "o_custkey", "o_totalprice"), table(s, d, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.count("*").alias("lines")), table(s, d, "lineitem").where("l_linenumber = 1").select(c("l_orderkey").alias("k"), "l_returnflag"), "k").groupBy("l_returnflag").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.round(F.sum("o_totalprice"), 2).alias("price")),
    "kb_retrieve": lambda s, d: _kb(s, d).select("query_id", "kb_id", "category", "severity", c("rank").cast("long").alias("rank")),
    "kb_counts": lambda s, d: migration.category_counts(_catalogue(s, d)),
    "recall_precision": lambda s, d: retrieval.retrieval_metrics(_kb(s, d), retrieval.gold_queries(s)),
    "vector_topk": lambda s, d: _topk(s, d).select("query_id", "id", F.round("score", 6).alias("score"), c("rank").cast("long").alias("rank")),
    "hybrid_merge": lambda s, d: retrieval.hybrid(_topk(s, d).select("query_id", "id", "rank"), _by_label(s, d)).select("query_id", "id", c("source").cast("long").alias("source"), c("rank").cast("long").alias("rank")),
}

ORACLE_SQL = {
    "bands": f"{WITH} SELECT finding_id, CASE WHEN score IS NOT NULL THEN coalesce({B_CLOSED}, 'unknown') END AS review, {B_CLOSED} AS quality, CASE WHEN score IS NULL OR score = 0 THEN 'informational' ELSE coalesce({B_CLOSED}, 'low') END AS benchmark, {B_OPEN.format('>= 0.1')} AS merge, {B_OPEN.format('> 0')} AS hard_negative FROM findings",
    "normalize_whitespace": f"SELECT doc_id, sha256(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS digest FROM documents",
    "parse_severity": f"{WITH} SELECT finding_id, severity FROM findings",
    "parse_cwe": f"{WITH} SELECT finding_id, CASE WHEN regexp_matches(cwe_id, '^CWE-') THEN cwe_id END AS cwe, CASE WHEN regexp_matches(cwe_id, '^CWE-') THEN title END AS description FROM findings",
    "parse_cvss": f"{WITH} SELECT finding_id, CASE WHEN score IS NOT NULL THEN round(score, 2) END AS score, CASE WHEN score IS NOT NULL AND vector LIKE 'CVSS%' THEN substring(vector, 6, 3) END AS version, CASE WHEN score IS NOT NULL AND vector LIKE 'CVSS%' THEN vector END AS vector, CASE WHEN score IS NOT NULL THEN coalesce(vector LIKE 'CVSS%', false) WHEN score IS NULL THEN false END AS parse_successful FROM findings",
    "extract_url": "SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages",
    "target_type": f"{WITH} SELECT finding_id, CASE WHEN lower(title) LIKE '%android%' OR lower(title) LIKE '%apk%' THEN 'android_application' WHEN lower(title) LIKE '%ios%' THEN 'ios_application' WHEN lower(title) LIKE '%web%' OR lower(title) LIKE '%url%' THEN 'web_application' WHEN lower(title) LIKE '%api%' THEN 'api' WHEN lower(title) LIKE '%jwt%' OR lower(title) LIKE '%token%' THEN 'cryptographic_component' WHEN lower(title) LIKE '%network%' THEN 'network' WHEN lower(title) LIKE '%cloud%' THEN 'cloud_resource' ELSE 'unknown' END AS target_type FROM findings",
    "keywords": f"{WITH} SELECT finding_id, array_to_string({KW % 'title'}, ' ') AS words, length(list_distinct({KW % 'observation'})) AS n_observation FROM findings",
    "truncate_snippet": "SELECT doc_id, sha256(CASE WHEN length(text) <= 120 THEN text ELSE rtrim(left(text, 120), ' ') || '...' END) AS digest FROM documents",
    "content_hash": f"{WITH} SELECT finding_id, sha256(finding_id || chr(31) || title || chr(31) || coalesce(severity, chr(0)))[1:16] AS hash FROM findings",
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
    "qc_issues": f"{QC_SQL} SELECT * FROM issues",
    "qc_status": f"{QC_SQL} SELECT * FROM statuses",
    "qc_summary": f"{QC_SQL} SELECT status, count(*) AS findings, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings FROM statuses GROUP BY 1",
    "exact_duplicates": f"SELECT fingerprint, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(chr(10) || text), '{WS}', ' ', 'g'))) AS fingerprint FROM documents) GROUP BY 1 HAVING count(*) > 1",
    "governance_gate": f"{WITH} SELECT finding_id, usage_approved IS TRUE AND usage_scope <> 'public' AS governance_valid, redaction_status = 'raw' AS redaction_warning, regexp_matches(finding_id, '^FND-[0-9]{{6}}$') AS structure_valid, usage_approved IS TRUE AND usage_scope <> 'public' AND regexp_matches(finding_id, '^FND-[0-9]{{6}}$') AS is_valid FROM findings",
    "key_faults": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 OR l_orderkey IS NULL",
    "key_set_differences": "WITH k AS (SELECT o_custkey AS k, 1 AS a, 0 AS b, 0 AS c FROM orders UNION ALL SELECT c_custkey, 0, 1, 0 FROM customer UNION ALL SELECT l_suppkey, 0, 0, 1 FROM lineitem) SELECT k, max(a) = 1 AS in_a, max(b) = 1 AS in_b, max(c) = 1 AS in_c FROM k GROUP BY k HAVING max(a) + max(b) + max(c) < 3",
    "enum_domain": f"{WITH} SELECT finding_id, 'severity' AS field, severity AS value FROM findings WHERE severity = 'unknown' UNION ALL SELECT finding_id, 'usage_scope', usage_scope FROM findings WHERE usage_scope = 'public'",
    "segment_ffill": f"SELECT conv_id, turn, last_value({LABEL_SQL} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations",
    "segment_interval_join": "WITH m AS (SELECT conv_id, turn AS s, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations WHERE role = 'user') SELECT conv_id, ordinal, min(turn) AS first, max(turn) AS last, count(*) AS blocks, count_if(coalesce(text, '') <> '') AS non_empty FROM conversations JOIN m USING (conv_id) WHERE turn >= s AND (e IS NULL OR turn < e) GROUP BY 1, 2",
    "section_collect": f"WITH f AS (SELECT *, {LABEL_SQL} AS l, last_value({LABEL_SQL} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations) SELECT conv_id, section, count(*) AS n, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM f WHERE l IS NULL AND section IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2",
    "missing_sections": f"WITH f AS (SELECT *, {LABEL_SQL} AS l, last_value({LABEL_SQL} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations) SELECT conv_id, section FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['observation', 'exploitation', 'recommendation', 'retest_verification']) AS section) EXCEPT SELECT conv_id, section FROM f WHERE l IS NULL AND trim(text) <> ''",
    "context_frame": "SELECT b.conv_id, b.turn, contains(b.text, 'and') AS is_match FROM conversations b WHERE EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) m, (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) x WHERE m.conv_id = b.conv_id AND x.conv_id = b.conv_id AND x.turn = b.turn AND contains(m.text, 'and') AND x.n BETWEEN m.n - 1 AND m.n + 2)",
    "block_inventory": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS block_number, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS user_number FROM conversations",
    "field_pivot": f"{WITH} SELECT finding_id, severity, CASE WHEN doc_id % 10 <> 0 THEN cwe_id END AS cwe, CAST(score AS VARCHAR) AS cvss FROM findings",
    "field_faults": f"{WITH} SELECT finding_id, 'unknown_label' AS fault, 'Owner' AS label FROM findings WHERE doc_id % 10 = 0",
    "missing_fields": f"{WITH} SELECT finding_id, CASE WHEN doc_id % 10 = 0 THEN 'cwe,impact' ELSE 'impact' END AS missing FROM findings",
    "three_way_join": "WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT f.l_returnflag, count(*) AS orders, sum(lines)::BIGINT AS lines, round(sum(o_totalprice), 2) AS price FROM lineitem f JOIN l USING (l_orderkey) JOIN orders ON o_orderkey = f.l_orderkey WHERE f.l_linenumber = 1 GROUP BY 1",
    "kb_retrieve": f"{KB_SQL} SELECT query_id, kb_id, category, severity, rank FROM hits",
    "kb_counts": f"{KB_SQL} SELECT category, count(*) AS n FROM kb GROUP BY ROLLUP (category)",
    "recall_precision": f"{KB_SQL} SELECT query_id, count(*) AS retrieved, count_if(list_contains(expected, kb_id)) / length(any_value(expected))::DOUBLE AS recall, count_if(rank <= 5 AND list_contains(relevant, kb_id)) / least(5, count(*))::DOUBLE AS precision FROM hits GROUP BY 1",
    "vector_topk": f"{TOPK_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "hybrid_merge": f"{TOPK_SQL}, b AS (SELECT query_id, id, 0 AS source, rank FROM r WHERE rank <= 5 UNION ALL SELECT q.vec_id, f.vec_id, 1, f.n FROM embeddings q JOIN (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) f ON f.label = q.label AND f.n <= 20 WHERE q.vec_id % 100 = 0), d AS (SELECT query_id, id, min(source * 1000 + rank) AS o FROM b GROUP BY 1, 2) SELECT query_id, id, o // 1000 AS source, row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS rank FROM d",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
