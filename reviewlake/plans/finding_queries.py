"""Queries from blocks to normalized findings, with their SQL twins.

Each row of ``documents`` stands for a document of two findings and an end marker. Its blocks hold faults by its id, and the
twins state from the id alone what must come out; they share no table or rule with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalization as N
from ..operators.segmentation import compact_table
from .synthetic import table

c = F.col
RUNS = "array<struct<block_number:int,block_type:string,text:string,rows:array<struct<row_number:int,cells:array<string>>>>>"
TITLES = {1: "First weakness", 2: "Second weakness"}


def _paragraph(n: int, text: str) -> str:
    return f"named_struct('block_number', {n}, 'block_type', 'paragraph', 'text', {text}, 'rows', null)"


def _table(n: int, rows: str) -> str:
    return f"named_struct('block_number', {n}, 'block_type', 'table', 'text', null, 'rows', {rows})"


def _metadata(o: int) -> str:
    severity = "element_at(array('INFO', 'weird', 'Critical ', 'high', 'Medium'), cast(doc_id % 5 as int) + 1)"
    target = """element_at(array('<a href="https://shop.example.test/a?x=1&amp;y=2">link</a>', 'Android  APK build', 'see http:///path', 'internal gateway'), cast(doc_id % 4 as int) + 1)"""
    cwe = "element_at(array('CWE-79: Some name', 'cwe-89 - Injection', 'none', 'CWE-22'), cast(doc_id % 4 as int) + 1)"
    cvss = "element_at(array('9.8 (CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H)', '7.5', 'cvss:3.0/av:l/ac:h/pr:l/ui:r/s:c/c:l/i:n/a:n', 'garbage'), cast(doc_id % 4 as int) + 1)"
    rows = [
        ("'Severity'", severity), ("'Affected Target:'", target), ("'CWE-ID'", cwe), ("CASE WHEN doc_id % 2 = 0 THEN 'Impact (Potential)' ELSE 'Impact' END", "'Loss of data'"),
        ("'Re-Test Status'", "CASE WHEN doc_id % 5 = 2 THEN 'Fixed  ' ELSE '' END"), ("'Affected User Role'", "CASE WHEN doc_id % 3 = 1 THEN 'Registered  user' ELSE ' ' END"), ("'CVSS (Score)'", cvss),
    ]
    if o == 1:
        rows[5] = (f"CASE WHEN doc_id % 13 = 1 THEN 'Owner' ELSE {rows[5][0]} END", rows[5][1])
    else:
        rows[3] = (f"CASE WHEN doc_id % 13 = 2 THEN 'Severity' ELSE {rows[3][0]} END", rows[3][1])
    cells = [f"array({label}, {value})" for label, value in rows]
    if o == 1:
        cells[6] = f"CASE WHEN doc_id % 13 = 3 THEN array('CVSS') ELSE {cells[6]} END"
    return "array(" + ", ".join(f"named_struct('row_number', {i}, 'cells', {x})" for i, x in enumerate(cells, 1)) + ")"


def _finding(o: int) -> list[str]:
    b = 20 * (o - 1)
    title = f"CASE WHEN doc_id % 23 = 9 THEN '{TITLES[3 - o]}' "
    title += f"WHEN doc_id % 23 = 8 THEN '{TITLES[1].upper()}' " if o == 1 else "WHEN doc_id % 23 = 5 THEN 'Renamed weakness' "
    title += f"ELSE '{TITLES[o]}' END"
    prelude = "CASE WHEN doc_id % 4 = 0 THEN 'Before any label' ELSE '' END"
    main, third = _table(b + 2, _metadata(o)), _paragraph(b + 3, prelude)
    if o == 1:
        third = f"CASE WHEN doc_id % 13 = 4 THEN {_table(b + 3, _metadata(o))} ELSE {third} END"
    else:
        main = f"CASE WHEN doc_id % 13 = 5 THEN {_paragraph(b + 2, chr(39) * 2)} ELSE {main} END"
    twelfth = "CASE WHEN doc_id % 11 = 3 THEN 'Recommendations' ELSE 'Rotate it' END" if o == 2 else "'Rotate it'"
    texts = {
        4: "CASE WHEN doc_id % 2 = 0 THEN 'Observation' ELSE 'Observations:' END", 5: "concat('Seen in build ', doc_id)", 6: "''", 7: "'More  detail'",
        8: "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'Exploitation' ELSE 'Proof of  Concept:' END", 9: "'Step one'", 10: "'Remediation'", 11: "'Remove it'", 12: twelfth,
        13: "'Re-Test Verification Result:'", 14: "CASE WHEN doc_id % 3 = 0 THEN 'Verified fixed' ELSE '' END",
    }
    return [_paragraph(b + 1, title), main, third, *[_paragraph(b + n, t) for n, t in texts.items()]]


def blocks(spark, sf_dir):
    end = [_paragraph(40, f"CASE WHEN doc_id % 23 = 6 THEN '{TITLES[1]}' ELSE '' END"), _paragraph(41, "CASE WHEN doc_id % 23 = 7 THEN 'Closing' ELSE 'Conclusion & Recommendations' END"), _paragraph(42, "'Thanks'")]
    every = F.expr("array(" + ", ".join(f"cast({x} as {RUNS[6:-1]})" for x in [*_finding(1), *_finding(2), *end]) + ")").cast(RUNS)
    rows = table(spark, sf_dir, "documents").select(_document(), F.explode(every).alias("x")).select("document_id", "x.*")
    return rows.withColumns({
        "paragraph_number": F.when(c("block_type") == "paragraph", c("block_number")), "table_number": F.when(c("block_type") == "table", F.when(c("block_number") == 3, 9).otherwise(F.when(c("block_number") < 20, 1).otherwise(2))),
        "style": F.when(c("block_number").isin(1, 21), "Heading 2"),
    })


def _document():
    return F.concat(F.lit("DOC-"), F.lpad(c("doc_id").cast("string"), 6, "0")).alias("document_id")


def registry(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(o).alias("ordinal"), F.lit(t).alias("title")) for o, t in TITLES.items()])
    return table(spark, sf_dir, "documents").select(_document(), F.explode(rows).alias("x")).select("document_id", "x.*")


def _expected(s, d):
    docs = table(s, d, "documents").select(_document(), "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("o"))
    title = F.when(c("doc_id") % 10 == 9, "Other title").when(c("o") == 1, TITLES[1]).otherwise(TITLES[2])
    return docs.select("document_id", F.format_string("FND-%06d", "o").alias("finding_id"), title.alias("title"), F.when(c("doc_id") % 6 == 5, 7).otherwise(c("o")).alias("table_number"))


def _registered(s, d):
    docs = table(s, d, "documents")
    third = docs.where("doc_id % 8 = 1").select(_document(), F.lit(3).alias("ordinal"))
    return registry(s, d).select("document_id", "ordinal").unionByName(third)


def _raw(s, d):
    return N.raw_findings(blocks(s, d), registry(s, d))


def _records(s, d):
    return N.normalized_findings(_raw(s, d)).select(
        "document_id", "finding_id", "schema_version", "title", "severity", c("affected_targets")[0]["target_type"].alias("target_type"), c("affected_targets")[0]["value"].alias("target"),
        F.array_join("affected_user_roles", ",").alias("roles"), "cwe_id", "cvss.version", "cvss.score", "cvss.vector", "impact", "observation", F.array_join("evidence.content", "|").alias("evidence"),
        F.array_join("evidence.evidence_id", "|").alias("evidence_id"), F.array_join("recommendation", "|").alias("recommendation"), c("retest.applicable").alias("applicable"), c("retest.status").alias("retest_status"),
        c("retest.verification_result").alias("verification"), F.array_join("references.value", ",").alias("refs"), "source.location.finding_number", "source.source_reference", "governance.usage_scope",
    )


def _cells(s, d):
    m = N.metadata(_raw(s, d))
    t = c("affected_targets")[0]
    return m.select(
        "document_id", "finding_id", c("source_table_number").cast("long").alias("table_number"), c("severity.normalized_value").alias("severity"), c("cwe.cwe_id").alias("cwe_id"), c("cwe.description").alias("cwe_description"),
        "impact.is_marked_potential", c("retest_status.normalized_value").alias("retest_status"), F.array_join("affected_user_roles.normalized_values", ",").alias("roles"), t["normalized_value"].alias("target"),
        F.array_join(t["notes"], ",").alias("target_notes"), "cvss.parse_successful", F.array_join("cvss.notes", ",").alias("cvss_notes"), c("source_fields.impact.label").alias("impact_label"), c("source_fields.cvss.row_number").cast("long").alias("cvss_row"),
    )


QUERIES = {
    "segmentation_faults": lambda s, d: N.segmentation_faults(blocks(s, d), registry(s, d)),
    "extraction_stats": lambda s, d: N.extraction_stats(_raw(s, d)).select("document_id", "finding_id", "title", c("start_block_number").cast("long").alias("first"), c("end_block_number").cast("long").alias("last"), "block_count", "non_empty_block_count", "tables"),
    "extraction_faults": lambda s, d: N.extraction_faults(_raw(s, d), registry(s, d)),
    "metadata_faults": lambda s, d: N.metadata_faults(_raw(s, d)),
    "metadata_parse": _cells,
    "section_faults": lambda s, d: N.section_faults(_raw(s, d)),
    "section_records": lambda s, d: N.section_records(_raw(s, d)).select("document_id", "finding_id", "section_name", "source_label", c("source_label_block").cast("long").alias("label_block"), F.array_join(F.transform("content_block_numbers", lambda x: x.cast("string")), ",").alias("blocks"), "combined_text", "content_present"),
    "section_summary": lambda s, d: N.section_summary(_raw(s, d)),
    "unclassified_paragraphs": lambda s, d: N.unclassified_paragraphs(_raw(s, d)).select("document_id", "finding_id", c("block_number").cast("long").alias("block_number"), "text"),
    "normalized_findings": _records,
    "extraction_checks": lambda s, d: N.extraction_checks(_raw(s, d), _expected(s, d)),
    "registry_differences": lambda s, d: N.registry_differences(_raw(s, d), _registered(s, d)).select("document_id", c("ordinal").cast("long").alias("ordinal"), "found", "expected"),
    "block_region": lambda s, d: N.region(blocks(s, d), c("text") == "Remediation", c("text") == "Remove it").groupBy("document_id").agg(F.min("block_number").cast("long").alias("first"), F.max("block_number").cast("long").alias("last"), F.count("*").alias("n")),
    "table_search": lambda s, d: N.tables_with(blocks(s, d), s.createDataFrame([("GARBAGE",), ("owner",), ("absent",)], "word string"), compact_table(c("rows"))).select("document_id", c("table_number").cast("long").alias("table_number"), "word"),
}

DOCS = """WITH d AS (SELECT doc_id, 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS document_id FROM documents),
f AS (SELECT *, 20 * (o - 1) AS b, 'FND-00000' || o AS finding_id, CASE o WHEN 1 THEN 'First weakness' ELSE 'Second weakness' END AS title
      FROM d, (SELECT unnest([1, 2]) AS o) WHERE doc_id % 23 NOT IN (5, 6, 7, 9)),
m AS (SELECT * FROM f WHERE NOT (o = 1 AND doc_id % 13 IN (1, 3, 4)) AND NOT (o = 2 AND doc_id % 13 IN (2, 5))),
s AS (SELECT * FROM f WHERE NOT (o = 1 AND doc_id % 23 = 8) AND NOT (o = 2 AND doc_id % 11 = 3))"""
_SEVERITY = "CASE doc_id % 5 WHEN 0 THEN 'informational' WHEN 2 THEN 'critical' WHEN 3 THEN 'high' WHEN 4 THEN 'medium' END"
_CWE = "CASE doc_id % 4 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' WHEN 3 THEN 'CWE-22' END"
_TARGET = "CASE doc_id % 4 WHEN 0 THEN 'https://shop.example.test/a?x=1&y=2' WHEN 1 THEN 'Android APK build' WHEN 2 THEN 'http:///path' ELSE 'internal gateway' END"
_STATUS = "CASE WHEN doc_id % 5 = 2 THEN 'Fixed' END"
_ROLES = "CASE WHEN doc_id % 3 = 1 THEN 'Registered user' ELSE '' END"
_OBSERVATION = "'Seen in build ' || doc_id || chr(10) || chr(10) || 'More  detail' || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || 'Step one' ELSE '' END"
_SECTIONS = f"""
 SELECT document_id, finding_id, 'observation' AS section_name, CASE WHEN doc_id % 2 = 0 THEN 'Observation' ELSE 'Observations:' END AS source_label, b + 4 AS label_block,
  (b + 5) || ',' || (b + 7) || CASE WHEN doc_id % 7 = 0 THEN ',' || (b + 9) ELSE '' END AS blocks, {_OBSERVATION} AS combined_text, true AS content_present FROM s
 UNION ALL SELECT document_id, finding_id, 'exploitation', CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'Exploitation' ELSE 'Proof of  Concept:' END, CASE WHEN doc_id % 7 <> 0 THEN b + 8 END,
  CASE WHEN doc_id % 7 <> 0 THEN (b + 9) || '' ELSE '' END, CASE WHEN doc_id % 7 <> 0 THEN 'Step one' END, doc_id % 7 <> 0 FROM s
 UNION ALL SELECT document_id, finding_id, 'recommendation', 'Remediation', b + 10, (b + 11) || ',' || (b + 12), 'Remove it' || chr(10) || chr(10) || 'Rotate it', true FROM s
 UNION ALL SELECT document_id, finding_id, 'retest_verification', 'Re-Test Verification Result:', b + 13, CASE WHEN doc_id % 3 = 0 THEN (b + 14) || '' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'Verified fixed' END, doc_id % 3 = 0 FROM s"""

ORACLE_SQL = {
    "segmentation_faults": f"{DOCS} SELECT document_id, 'title_count' AS fault, 'Second weakness: 0' AS detail FROM d WHERE doc_id % 23 = 5 UNION ALL SELECT document_id, 'title_count', 'First weakness: 2' FROM d WHERE doc_id % 23 = 6 UNION ALL SELECT document_id, 'end_marker', 'conclusion & recommendations' FROM d WHERE doc_id % 23 = 7 UNION ALL SELECT document_id, 'title_order', 'Second weakness' FROM d WHERE doc_id % 23 = 9",
    "extraction_stats": f"{DOCS} SELECT document_id, finding_id, title, b + 1 AS first, CASE o WHEN 1 THEN 14 ELSE 40 END AS last, CASE o WHEN 1 THEN 14 ELSE 15 END AS block_count, 10 + CASE WHEN doc_id % 4 = 0 OR (doc_id % 13 = 4 AND o = 1) THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 13 = 5 AND o = 2 THEN 1 ELSE 0 END AS non_empty_block_count, CASE WHEN doc_id % 13 = 4 AND o = 1 THEN 2 WHEN doc_id % 13 = 5 AND o = 2 THEN 0 ELSE 1 END AS tables FROM f",
    "extraction_faults": f"{DOCS} SELECT document_id, finding_id, 'no_table' AS fault FROM f WHERE doc_id % 13 = 5 AND o = 2 UNION ALL SELECT document_id, 'FND-00000' || o, 'not_extracted' FROM d, (SELECT unnest([1, 2]) AS o) WHERE doc_id % 23 IN (5, 6, 7, 9)",
    "metadata_faults": f"""{DOCS} SELECT document_id, finding_id, fault, detail FROM f JOIN (VALUES (1, 1, 'unknown_label', 'Owner'), (1, 1, 'missing_fields', 'affected_user_roles'), (2, 2, 'duplicate_field', 'severity'), (2, 2, 'missing_fields', 'impact'),
        (3, 1, 'short_row', '7'), (3, 1, 'missing_fields', 'cvss'), (4, 1, 'table_count', '2'), (5, 2, 'table_count', '0')) AS x(kind, own, fault, detail) ON doc_id % 13 = kind AND o = own""",
    "metadata_parse": f"""{DOCS} SELECT document_id, finding_id, o AS table_number, {_SEVERITY} AS severity, {_CWE} AS cwe_id, CASE doc_id % 4 WHEN 0 THEN 'Some name' WHEN 1 THEN 'Injection' END AS cwe_description, doc_id % 2 = 0 AS is_marked_potential,
        {_STATUS} AS retest_status, {_ROLES} AS roles, {_TARGET} AS target, CASE doc_id % 4 WHEN 0 THEN 'contains markup' WHEN 2 THEN 'URL without a host' ELSE '' END AS target_notes, doc_id % 4 = 0 AS parse_successful,
        CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'vector not parsed' WHEN 2 THEN 'score not parsed' ELSE 'score not parsed,vector not parsed' END AS cvss_notes, CASE WHEN doc_id % 2 = 0 THEN 'Impact (Potential)' ELSE 'Impact' END AS impact_label, 7 AS cvss_row FROM m""",
    "section_faults": f"{DOCS} SELECT document_id, finding_id, 'duplicate_section' AS fault, 'recommendation' AS detail FROM f WHERE doc_id % 11 = 3 AND o = 2 UNION ALL SELECT document_id, finding_id, 'first_paragraph', 'FIRST WEAKNESS' FROM f WHERE doc_id % 23 = 8 AND o = 1",
    "section_records": f"{DOCS} {_SECTIONS}",
    "section_summary": f"{DOCS} SELECT document_id, finding_id, CASE WHEN doc_id % 7 = 0 THEN 'observation,recommendation,retest_verification' ELSE 'observation,exploitation,recommendation,retest_verification' END AS labels_found, CASE WHEN doc_id % 7 = 0 THEN 'exploitation' ELSE '' END AS missing_labels, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'retest_verification' END AS empty_sections, CASE WHEN doc_id % 4 = 0 AND NOT (doc_id % 13 = 4 AND o = 1) THEN 1 ELSE 0 END AS unclassified_paragraphs FROM s",
    "unclassified_paragraphs": f"{DOCS} SELECT document_id, finding_id, b + 3 AS block_number, 'Before any label' AS text FROM f WHERE doc_id % 4 = 0 AND NOT (doc_id % 13 = 4 AND o = 1)",
    "normalized_findings": f"""{DOCS} SELECT document_id, finding_id, '0.2' AS schema_version, title, {_SEVERITY} AS severity, CASE doc_id % 4 WHEN 1 THEN 'android_application' WHEN 3 THEN 'unknown' ELSE 'web_application' END AS target_type, {_TARGET} AS target, {_ROLES} AS roles,
        {_CWE} AS cwe_id, CASE doc_id % 4 WHEN 0 THEN '3.1' WHEN 2 THEN '3.0' END AS version, CASE doc_id % 4 WHEN 0 THEN 9.8 WHEN 1 THEN 7.5 END::DOUBLE AS score, CASE doc_id % 4 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' WHEN 2 THEN 'CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:C/C:L/I:N/A:N' END AS vector,
        'Loss of data' AS impact, {_OBSERVATION} AS observation, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Step one' END AS evidence, CASE WHEN doc_id % 7 = 0 THEN '' ELSE finding_id || '-EVID-001' END AS evidence_id, 'Remove it|Rotate it' AS recommendation,
        CASE WHEN doc_id % 5 = 2 OR doc_id % 3 = 0 THEN true END AS applicable, {_STATUS} AS retest_status, CASE WHEN doc_id % 3 = 0 THEN 'Verified fixed' END AS verification, coalesce({_CWE}, '') AS refs, o || '' AS finding_number,
        'blocks:' || (b + 1) || '-' || CASE o WHEN 1 THEN 14 ELSE 40 END || ';title_paragraph:' || (b + 1) AS source_reference, 'internal' AS usage_scope FROM m SEMI JOIN s USING (document_id, finding_id)""",
    "extraction_checks": f"""{DOCS} SELECT document_id, finding_id, 'title_match' AS "check" FROM f WHERE doc_id % 10 = 9 UNION ALL SELECT document_id, finding_id, 'first_paragraph_title' FROM f WHERE doc_id % 10 = 9 OR (doc_id % 23 = 8 AND o = 1)
        UNION ALL SELECT document_id, finding_id, 'metadata_table_count' FROM f WHERE (doc_id % 13 = 4 AND o = 1) OR (doc_id % 13 = 5 AND o = 2)
        UNION ALL SELECT document_id, finding_id, 'metadata_table_number' FROM f WHERE doc_id % 6 = 5 AND NOT ((doc_id % 13 = 4 AND o = 1) OR (doc_id % 13 = 5 AND o = 2))
        UNION ALL SELECT document_id, finding_id, 'section_label_observation' FROM f WHERE doc_id % 2 = 1 UNION ALL SELECT document_id, finding_id, 'section_label_exploitation' FROM f WHERE doc_id % 2 = 1 OR doc_id % 7 = 0
        UNION ALL SELECT document_id, finding_id, 'continuous_block_range' FROM f WHERE o = 2""",
    "registry_differences": f"{DOCS} SELECT document_id, o AS ordinal, NULL::VARCHAR AS found, 'FND-00000' || o AS expected FROM d, (SELECT unnest([1, 2, 3]) AS o) WHERE (o = 3 AND doc_id % 8 = 1) OR (o < 3 AND doc_id % 23 IN (5, 6, 7, 9))",
    "block_region": f"{DOCS} SELECT document_id, 10 AS first, 11 AS last, 2 AS n FROM d",
    "table_search": f"""{DOCS} SELECT document_id, t AS table_number, 'GARBAGE' AS word FROM d, (SELECT unnest([1, 2, 9]) AS t) WHERE doc_id % 4 = 3 AND NOT (t = 1 AND doc_id % 13 = 3) AND NOT (t = 2 AND doc_id % 13 = 5) AND (t <> 9 OR doc_id % 13 = 4)
        UNION ALL SELECT document_id, 1, 'owner' FROM d WHERE doc_id % 13 = 1""",
}
